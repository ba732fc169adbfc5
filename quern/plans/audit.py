"""Pairing, duplicates, conflicts, splits and identifiers over documents, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.columns import case_identifier, group_digest
from quern.operators import audit, resolve, splitting
from quern.plans.metrics import rounded
from quern.plans.registry import query, read
from quern.sources import files

_HASHED = "d AS (SELECT doc_id, sha256(text) AS h, source, lang, n_chars, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM documents)"


def documents(spark, sf_dir):
    """doc_id, content hash, source (class), lang (stratum) and a split by id; the text itself never leaves the scan."""
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "val").otherwise("test")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source", "lang", "n_chars", split.alias("split"))


@query(f"WITH {_HASHED} SELECT h, count(*) AS group_size, count(DISTINCT source) AS n_source, count(DISTINCT lang) AS n_lang FROM d GROUP BY h HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return audit.exact_groups(documents(spark, sf_dir), "h", "source", "lang")


@query("""WITH p AS (SELECT coalesce(c_custkey, o_custkey) AS custkey, CASE WHEN o_custkey IS NULL THEN 'missing_mask' WHEN c_custkey IS NULL THEN 'orphan_mask' END AS status
    FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 <> 0) ON c_custkey = o_custkey) SELECT status, custkey FROM p WHERE status IS NOT NULL ORDER BY custkey LIMIT 10""")
def unpaired_preview(spark, sf_dir):
    """What the error of a fatal pairing names: the first keys without a partner."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    orders = read(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("custkey")).distinct()
    return audit.unpaired(audit.pair_up(customers, orders, ["custkey"]), ["custkey"])


_CONTENTS = {"image": "h", "mask": "m"}


@query(f"""WITH {_HASHED}, e AS (SELECT *, CASE WHEN n_chars > 0 THEN sha256(source || '|' || n_chars) END AS m FROM d), u AS (SELECT 'image' AS kind, h AS hash, doc_id, source, split FROM e UNION ALL SELECT 'mask', m, doc_id, source, split FROM e WHERE m IS NOT NULL)
  SELECT kind, hash, doc_id, source, split, count(*) OVER (PARTITION BY kind, hash) AS group_size FROM u QUALIFY count(*) OVER (PARTITION BY kind, hash) > 1""")
def dup_members(spark, sf_dir):
    """The text stands for the image; source and length, where there is any, for the mask."""
    rows = documents(spark, sf_dir).withColumn("m", F.when(F.col("n_chars") > 0, F.sha2(F.concat("source", F.lit("|"), F.col("n_chars").cast("string")), 256)))
    return audit.tagged_members(rows, _CONTENTS).select("kind", "hash", "doc_id", "source", "split", "group_size")


@query(f"WITH {_HASHED} SELECT h, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM d GROUP BY h HAVING count(DISTINCT split) > 1")
def dup_cross_split(spark, sf_dir):
    return audit.leaking(documents(spark, sf_dir), "h").withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {_HASHED} SELECT h, count(*) AS group_size, count(DISTINCT source) AS n_source FROM d GROUP BY h HAVING count(DISTINCT source) > 1")
def label_conflicts(spark, sf_dir):
    return audit.exact_groups(documents(spark, sf_dir), "h", "source").where("n_source > 1")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing_mask' WHEN a.k IS NULL THEN 'orphan_mask' ELSE 'paired' END AS status FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0) a FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k")
def pair_full_outer(spark, sf_dir):
    return audit.pair_up(*_halves(spark, sf_dir), ["k"])


def _halves(spark, sf_dir):
    images = read(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"))
    return images, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()


@query("SELECT 'missing' AS kind, o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'orphan', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0)")
def missing_orphans(spark, sf_dir):
    images = read(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"))
    return audit.one_sided(images, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query(f"WITH {_HASHED} SELECT doc_id, h FROM d WHERE split = 'train' AND h IN (SELECT h FROM d WHERE split = 'test')")
def frozen_test_semi(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return audit.with_test_twin(rows.where("split = 'train'"), rows.where("split = 'test'"), "h").select("doc_id", "h")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def quarantine_anti(spark, sf_dir):
    bad = read(spark, sf_dir, "labels").where("quality = 0")
    return audit.missing_in(read(spark, sf_dir, "documents").select("doc_id", "source"), bad, ["doc_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 20000)")
def patient_exclusion(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return audit.exclude_groups(orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", F.col("o_totalprice") < 20000).select("o_orderkey", "o_custkey")


@query(f"WITH {_HASHED} SELECT h, count(*) AS group_size, count(DISTINCT source) AS n_source FROM d GROUP BY h HAVING count(*) > 1 AND count(DISTINCT source) > 1 AND count(DISTINCT lang) = 1")
def cross_patient_duplicates(spark, sf_dir):
    return audit.exact_groups(documents(spark, sf_dir), "h", "source", "lang").where("n_source > 1 and n_lang = 1").drop("n_lang")


@query("SELECT source, lang, count(*) AS count FROM documents GROUP BY ALL")
def count_by_class_source(spark, sf_dir):
    return audit.transition_counts(read(spark, sf_dir, "documents"), "source", "lang")


@query(f"WITH {_HASHED} SELECT lang, source, split, count(*) AS count FROM d GROUP BY ALL")
def transition_counts(spark, sf_dir):
    return audit.transition_counts(documents(spark, sf_dir), "lang", "source", "split")


@query(f"WITH {_HASHED} SELECT split, count(*) AS count, round(count(*) / (SELECT count(*) FROM d), 6) AS share FROM d GROUP BY split")
def split_ratio(spark, sf_dir):
    return rounded(audit.split_shares(documents(spark, sf_dir)))


_RULES = [("error", "empty_text", "n_chars = 0", "no characters"), ("warning", "short_text", "n_chars < 100", "under 100 characters"), ("warning", "long_text", "n_chars > 5000", "over 5000 characters"), ("info", "no_source", "source IS NULL", "source missing")]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, '{c}' AS code, count(*) FILTER ({w}) AS count, '{d}' AS detail FROM documents" for s, c, w, d in _RULES) + ") WHERE count > 0")
def issue_list(spark, sf_dir):
    return audit.issue_list(read(spark, sf_dir, "documents"), [(s, c, F.expr(w), d) for s, c, w, d in _RULES])


@query("SELECT source, count(*) AS n, CASE WHEN source = 'src3' THEN 'different_data' WHEN count(*) <> (SELECT count(*) FROM documents WHERE source = 'src0') THEN 'different_count' ELSE 'comparable' END AS status, CASE WHEN source <> 'src3' AND count(*) = (SELECT count(*) FROM documents WHERE source = 'src0') THEN round(avg(n_chars), 6) END AS score FROM documents GROUP BY source")
def comparability_gate(spark, sf_dir):
    runs = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("score"))
    expected = read(spark, sf_dir, "documents").where("source = 'src0'").count()
    print_ = F.when(F.col("source") == "src3", "other").otherwise("same")
    return audit.comparable(runs, print_, F.col("n"), "same", expected, "score")


# ---- splits -----------------------------------------------------------------------------------------------------------


def _grouped(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), F.substring("h", 1, 12).alias("group_id"), "source", "lang", "n_chars")


_GROUPED = f"{_HASHED}, sm AS (SELECT substr(h, 1, 12) AS group_id, source, lang FROM d)"
_SHARES = {"train": 0.7, "val": 0.15, "test": 0.15}


def _deficit(s: str) -> str:
    return f"round((CAST({_SHARES[s]} AS DOUBLE) * total - {{a}}.{s}) / greatest(CAST({_SHARES[s]} AS DOUBLE) * total, 1.0), 12)"


def _choice(a: str, seed: str = "'42'") -> str:
    """The split with the largest deficit, of equals that whose hash with the group is least."""
    rows = ", ".join(f"{{'d': -({_deficit(s).format(a=a)}), 'h': sha256({seed} || '|' || g.group_id || '|{s}'), 's': '{s}'}}" for s in _SHARES)
    return f"list_sort([{rows}])[1].s"


_ORDERED_B = "g AS (SELECT lang, source, group_id, count(*) AS size, sum(count(*)) OVER (PARTITION BY lang, source) AS total, row_number() OVER (PARTITION BY lang, source ORDER BY count(*) DESC, sha256('42|' || lang || ', ' || source || '|' || group_id)) AS n FROM sm GROUP BY 1, 2, 3)"
_ADDED = ", ".join(f"f.{s} + CASE WHEN f.choice = '{s}' THEN f.size ELSE 0 END AS {s}" for s in _SHARES)


_ORDERED_A = """g AS (SELECT source, seed, group_id, count(*) AS size, sum(count(*)) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, sha256(seed || '|' || source || '|' || group_id)) AS n
    FROM (SELECT source, CAST(42 + CAST('0x' || substr(sha256(source), 1, 8) AS BIGINT) AS VARCHAR) AS seed, source || '_' || group_id AS group_id FROM sm) GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {_GROUPED}, {_ORDERED_A}, z AS (SELECT 0 AS train, 0 AS val, 0 AS test), f AS (SELECT g.source, g.seed, g.group_id, g.n, g.size, CAST(0 AS BIGINT) AS train, CAST(0 AS BIGINT) AS val, CAST(0 AS BIGINT) AS test, {_choice('z', 'g.seed')} AS choice FROM g, z WHERE n = 1
    UNION ALL SELECT source, seed, group_id, n, size, train, val, test, {_choice('g', 'g.seed')} FROM (SELECT g.*, {_ADDED} FROM f JOIN g ON g.source = f.source AND g.n = f.n + 1) g)
  SELECT source, group_id, choice AS split FROM f""")
def split_stratified_a(spark, sf_dir):
    rows = _grouped(spark, sf_dir).withColumn("group_id", F.concat_ws("_", "source", "group_id"))
    return splitting.allocate_stratified(rows, "source", 42)


@query(f"""WITH RECURSIVE {_GROUPED}, {_ORDERED_B}, z AS (SELECT 0 AS train, 0 AS val, 0 AS test), f AS (SELECT g.lang, g.source, g.group_id, g.n, g.size, CAST(0 AS BIGINT) AS train, CAST(0 AS BIGINT) AS val, CAST(0 AS BIGINT) AS test, {_choice('z')} AS choice FROM g, z WHERE n = 1
    UNION ALL SELECT lang, source, group_id, n, size, train, val, test, {_choice('g')} FROM (SELECT g.*, {_ADDED} FROM f JOIN g ON g.lang = f.lang AND g.source = f.source AND g.n = f.n + 1) g)
  SELECT lang, source, group_id, choice AS split FROM f""")
def split_fold_b(spark, sf_dir):
    return splitting.allocate_by_deficit(_grouped(spark, sf_dir), ["lang", "source"], 42)


def _error(chosen: str) -> str:
    """Sum over splits of the squared relative errors of samples and of positive samples, with the group in ``chosen``."""
    terms = []
    for s, r in _SHARES.items():
        for have, whole, add in ((f"{s}_n", "n_all", "size"), (f"{s}_p", "p_all", "pos")):
            error = f"(({have} + {add if s == chosen else 0} - CAST({r} AS DOUBLE) * {whole}) / greatest(CAST({r} AS DOUBLE) * {whole}, 1.0))"
            terms.append(f"{error} * {error}")
    return " + ".join(terms)


_COUNTS_C = [f"{s}_{k}" for s in _SHARES for k in ("n", "p")]
_PICK_C = "CASE WHEN e3 < least(e1, CASE WHEN e2 < e1 - 1e-12 THEN e2 ELSE e1 END) - 1e-12 THEN 'test' WHEN e2 < e1 - 1e-12 THEN 'val' ELSE 'train' END"


@query(f"""WITH RECURSIVE g AS (SELECT CAST(o_custkey AS VARCHAR) AS group_id, count(*) AS size, count(*) FILTER (o_orderpriority = '1-URGENT') AS pos, sum(count(*)) OVER () AS n_all, sum(count(*) FILTER (o_orderpriority = '1-URGENT')) OVER () AS p_all,
    row_number() OVER (ORDER BY count(*) DESC, count(*) FILTER (o_orderpriority = '1-URGENT') DESC, sha256('42|' || o_custkey)) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
  f AS (SELECT n, group_id, size, pos, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in _COUNTS_C)}, {_PICK_C} AS split FROM (SELECT *, {_error('train')} AS e1, {_error('val')} AS e2, {_error('test')} AS e3 FROM (SELECT *, {', '.join(f'0 AS {c}' for c in _COUNTS_C)} FROM g WHERE n = 1))
    UNION ALL SELECT n, group_id, size, pos, {', '.join(_COUNTS_C)}, {_PICK_C} FROM (SELECT *, {_error('train')} AS e1, {_error('val')} AS e2, {_error('test')} AS e3 FROM (SELECT g.*, {', '.join(f"f.{s}_{k} + CASE WHEN f.split = '{s}' THEN f.{a} ELSE 0 END AS {s}_{k}" for s in _SHARES for k, a in (('n', 'size'), ('p', 'pos')))} FROM f JOIN g ON g.n = f.n + 1)))
  SELECT group_id, split FROM f""")
def split_fold_c(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_custkey is not null").select(F.col("o_custkey").cast("string").alias("group_id"), "o_orderpriority")
    return splitting.allocate_by_error(orders, F.col("o_orderpriority") == "1-URGENT", 42)


_ORDERED_D = "g AS (SELECT lang, group_id, count(*) AS size, round(CAST(0.18 AS DOUBLE) * sum(count(*)) OVER (PARTITION BY lang), 0) AS target, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || lang || '|' || group_id)) AS n FROM sm GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_GROUPED}, {_ORDERED_D}, f AS (SELECT lang, group_id, n, CASE WHEN abs(size - target) <= abs(target) THEN size ELSE 0 END AS have, CASE WHEN abs(size - target) <= abs(target) THEN 'val' ELSE 'train' END AS split FROM g WHERE n = 1
    UNION ALL SELECT g.lang, g.group_id, g.n, f.have + CASE WHEN abs(f.have + g.size - g.target) <= abs(f.have - g.target) THEN g.size ELSE 0 END, CASE WHEN abs(f.have + g.size - g.target) <= abs(f.have - g.target) THEN 'val' ELSE 'train' END FROM f JOIN g ON g.lang = f.lang AND g.n = f.n + 1)
  SELECT lang, group_id, split FROM f""")
def split_frozen_d(spark, sf_dir):
    return splitting.allocate_validation(_grouped(spark, sf_dir), "lang", 42)


@query(f"WITH {_HASHED} SELECT doc_id, source, split FROM d WHERE h NOT IN (SELECT h FROM d WHERE n_chars < 200)")
def split_preserve_e(spark, sf_dir):
    return splitting.preserve(documents(spark, sf_dir), "h", F.col("n_chars") < 200).select("doc_id", "source", "split")


@query(f"""WITH {_HASHED} SELECT 'duplicate_ids' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM d GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'unknown_split', count(*) FILTER (split NOT IN ('train', 'val', 'test')) FROM d
  UNION ALL SELECT 'leaking_groups', (SELECT count(*) FROM (SELECT h FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1)) UNION ALL SELECT 'empty_splits', 3 - count(DISTINCT split) FROM d""")
def split_validation(spark, sf_dir):
    return splitting.validate(documents(spark, sf_dir), "doc_id", "h")


#: A level of the tree: groups of ``k`` hex digits become entries of groups of one digit less; trees that aren't so deep pass.
def _level(k: int) -> str:
    return f"""t{k} AS (SELECT CASE WHEN length(p) = {k} THEN left(p, {max(k - 1, 0)}) ELSE p END AS p, d, x FROM (SELECT p, p AS d, sha256(string_agg(x, chr(10) ORDER BY d)) AS x FROM t{k + 1} WHERE length(p) = {k} GROUP BY p) UNION ALL SELECT p, d, x FROM t{k + 1} WHERE length(p) < {k})"""


@query(f"""WITH r AS (SELECT sha256(doc_id || '|' || coalesce(source, '') || '|' || coalesce(lang, '') || chr(10)) AS d, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS rows FROM r),
  t5 AS (SELECT left(d, CASE WHEN c <= {splitting.LEAF} THEN 0 WHEN c <= {16 * splitting.LEAF} THEN 1 WHEN c <= {256 * splitting.LEAF} THEN 2 WHEN c <= {4096 * splitting.LEAF} THEN 3 ELSE 4 END) AS p, d, d || ':' || n AS x FROM r, m),
  {', '.join(_level(k) for k in (4, 3, 2, 1))} SELECT (SELECT rows FROM m) AS rows, sha256(string_agg(x, chr(10) ORDER BY d)) AS fingerprint FROM t1""")
def dataset_fingerprint(spark, sf_dir):
    return splitting.fingerprint(read(spark, sf_dir, "documents"), "doc_id", "source", "lang")


@query("""SELECT sha256(text) AS h, 'dedup_' || substr(sha256(string_agg(CAST(doc_id AS VARCHAR), '
' ORDER BY CAST(doc_id AS VARCHAR))), 1, 16) AS duplicate_group FROM documents GROUP BY 1 HAVING count(*) > 1""")
def component_id(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.col("doc_id").cast("string").alias("id"))
    return rows.groupBy("h").agg(group_digest(F.col("id")).alias("duplicate_group"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("SELECT page_id, 'k3m_' || regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') || CASE WHEN right(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), 1) = '_' THEN 'case' ELSE '' END AS case_id FROM pages")
def case_identifiers(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", case_identifier(F.col("url")).alias("case_id"))


@query("SELECT page_id, regexp_replace(url, '^https?:/', '') AS relative, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER), 0) AS number, regexp_extract(url, '://([^/]+)', 1) AS parent FROM pages")
def path_parse(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", files.relative_path(url, "https?:/").alias("relative"), F.coalesce(F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as int)"), F.lit(0)).alias("number"),
        F.regexp_extract(url, "://([^/]+)", 1).alias("parent"),
    )


@query(f"WITH {_HASHED} SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS INTEGER) AS new_id FROM d")
def renumber(spark, sf_dir):
    return splitting.renumber(documents(spark, sf_dir), "source", "lang", "doc_id").select("doc_id", "source", "new_id")


@query(f"WITH {_HASHED} SELECT h, doc_id, source FROM d QUALIFY row_number() OVER (PARTITION BY h ORDER BY n_chars DESC, doc_id) = 1")
def canonical_member(spark, sf_dir):
    return resolve.canonical(documents(spark, sf_dir), "h", F.desc("n_chars"), "doc_id").select("h", "doc_id", "source")


@query(f"""WITH {_HASHED}, g AS (SELECT h, min(doc_id) AS component, count(*) AS component_size, count(DISTINCT source) AS n FROM d GROUP BY h)
  SELECT doc_id, component, component_size, CASE WHEN component_size = 1 THEN NULL WHEN n > 1 THEN 'label_conflict' WHEN doc_id <> component THEN 'duplicate_redundant' END AS reason FROM d JOIN g USING (h)""")
def resolve_duplicates(spark, sf_dir):
    rows = documents(spark, sf_dir)
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("component"))
    return resolve.resolve(rows.join(groups, "h"), "doc_id", "source", []).select("doc_id", "component", "component_size", "reason")
