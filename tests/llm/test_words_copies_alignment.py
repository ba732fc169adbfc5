"""Spelling variants, exact duplicates and aligned tokens against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import alignment, exact, spelling

SCHEMA = "doc_id long, text string, word string, hash string, row string"
OTHERS = ("clash",) * 3


# ---- 11 spelling variants -----------------------------------------------------------------------------------------------


def near_by_loop(words):
    """Pairs one edit apart, by deleting a letter of either."""
    cut = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[k, w[:k] + w[k + 1 :]].add(w)
    near = {(a, b) for group in cut.values() for a in group for b in group if a != b}
    for w in words:
        for k in range(len(w)):
            if (shorter := w[:k] + w[k + 1 :]) in words:
                near |= {(w, shorter), (shorter, w)}
    return near


def variants_by_loop(rows, damaged=spelling.DAMAGED, least=spelling.LEAST_SEEN):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damaged == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near, out = defaultdict(list), {}
    for a, b in near_by_loop(n):
        near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def made_words(rng, count):
    base = ["".join(rng.choice("abcdeéßÀ÷") for _ in range(rng.randint(5, 11))) for _ in range(count)]
    out = set(base)
    for w in base:
        for _ in range(3):
            k, c = rng.randrange(len(w)), rng.choice("abcdeé")
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            out.add(w)
    return sorted(out | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150})


def test_variants_match_a_loop(spark):
    rng = random.Random(5)
    vocabulary = made_words(rng, 80)
    weights = [rng.choice([1, 1, 2, 6, 40]) for _ in vocabulary]
    rows = [(k, " ".join(rng.choice([w, w, w.upper(), w + "1", "ł" + w]) for w in rng.choices(vocabulary, weights, k=rng.randint(0, 400)))) for k in range(40)]
    rows += [(None, "Aaaaaa " * 7), (7, rows[3][1]), (8, None), (9, ""), (10, "퟿×÷" * 9 + " " + "q" * 100_000), (11, " ".join(["q" * 100_000] * 5))]
    rows += [(20 + k, "Chainword " * 50 + "chainwords " * 8 + "chainwordsy") for k in range(6)]
    docs = spark.createDataFrame([(*r, *OTHERS) for r in rows], SCHEMA).repartition(5)
    chained = False
    for damaged in (spelling.DAMAGED, 3):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, damaged=damaged).collect()}
        assert got == variants_by_loop(rows, damaged) and len(got) > 100
        chained |= any(root not in (w, form) for w, (form, root, *_) in got.items())
    assert chained
    assert spelling.variants(docs.limit(0)).collect() == []


def test_near_words_in_small_shards_and_blocks(spark):
    """Crowded halves are dealt in blocks; every pair is met exactly once."""
    rng = random.Random(6)
    words = sorted({*made_words(rng, 150), *(f"common{a}{b}" for a in "abcdefgh" for b in "abcdefghij"), *(f"{a}{b}ending" for a in "abcdefgh" for b in "abcdefghij")})
    n = {w: rng.randint(1, 4) for w in words}
    near, want = defaultdict(list), {}
    for a, b in near_by_loop(set(words)):
        near[a].append(b)
    want = {w: (len(x), *min((-n[y], y) for y in x)) for w, x in near.items()}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    for shard_rows, block in ((spelling.SHARD_ROWS, spelling.BLOCK_WORDS), (50, 7), (10, 1_000)):
        got = {r.word: (r.n_near, -r.best_n, r.best) for r in spelling.near_words(frame, shard_rows, block).collect()}
        assert got == want


# ---- 12 exact duplicates ------------------------------------------------------------------------------------------------


def copies():
    rng = random.Random(8)
    texts = ["same text"] * 40 + [f"text {k % 9}" for k in range(30)] + [f"only {k}" for k in range(20)] + [None, "", " ", "Same text", "samé", "samé", "z" * 300_000, "z" * 300_000, "z" * 300_001]
    ids = rng.sample(range(1000), len(texts))
    return [*zip(ids, texts, strict=True), (5000, "twice"), (5000, "twice"), (5001, "twice"), (5001, "other"), (None, "no id"), (None, "no id"), (None, "text 3"), (6000, None)]


def copies_by_loop(rows, smallest):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = Counter()
    for text, docs in groups.items():
        known = [d for d in docs if d is not None]
        keep = (min if smallest else max)(known) if known else None
        sha, once = hashlib.sha256(text.encode()).hexdigest(), False
        for d in docs:
            kept = d == keep and not once
            once |= kept
            out[d, keep, len(docs), kept, sha] += 1
    return out


@pytest.mark.parametrize("smallest", [True, False])
def test_copies_match_a_loop(spark, smallest):
    rows = copies()
    docs = spark.createDataFrame([(*r, *OTHERS) for r in rows], SCHEMA).repartition(6)
    weak = lambda text: F.substring(F.unhex(F.md5(text)), 1, 1).bitwiseAND(0) if False else F.unhex(F.substring(F.md5(text), 1, 1))
    for how in ({}, {"most": 0}, {"digest": weak}, {"digest": weak, "most": 0}):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.judge(docs, smallest, **how).collect())
        assert got == copies_by_loop(rows, smallest), how
    assert exact.judge(docs.limit(0)).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    rows = copies()
    docs = spark.createDataFrame([(*r, *OTHERS) for r in rows], SCHEMA)
    stay = exact.deduplicate(docs).collect()
    wanted = Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for (d, keep, _, kept, sha), m in copies_by_loop(rows, True).items() if kept for t in [next(t for e, t in rows if e == d and hashlib.sha256((t or "").encode()).hexdigest() == sha)] for _ in range(m))
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in stay) == wanted and all(r.word == "clash" for r in stay)
    shouted = exact.judge(docs, normalise=lambda t: F.lower(t)).where("kept").count()
    assert shouted == len({(t or "").lower() for _, t in rows})


# ---- 13 aligned tokens --------------------------------------------------------------------------------------------------


def aligned_by_loop(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    byte_of = {chr(x): x for x in plain}
    byte_of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    names = {v: k for k, v in a.get_vocab().items()}

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends)) if parts else []

    held, out = defaultdict(set), []
    for r, (_, text) in enumerate(rows):
        whole = b" " + text.encode() if text else b""
        ids_a = a.encode(whole.decode(), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in names[k]) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(([], [], [], []))
            continue
        at, bt = spans(bytes_a), spans(bytes_b)
        cuts = sorted({e for _, e in at} & {e for _, e in bt})
        groups = [(",".join(str(k) for k, (_, e) in zip(ids_a, at) if low < e <= high), ",".join(str(k) for k, (_, e) in zip(ids_b, bt) if low < e <= high)) for low, high in zip([0, *cuts], cuts)]
        links = [(x, y) for x, (p, q) in zip(ids_a, at) for y, (s, t) in zip(ids_b, bt) if p < t and s < q]
        for pair in links:
            held[pair].add(r)
        out.append((ids_a, ids_b, groups, links))
    best = defaultdict(int)
    for (x, _), docs in held.items():
        best[x] = max(best[x], len(docs))
    done = []
    for (doc, _), (ids_a, ids_b, groups, links) in zip(rows, out):
        sha = hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if groups else ""
        done.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(len(held[p]) == best[p[0]] for p in links), sum(len(held[p]) for p in links), sha))
    return done, {p: len(d) for p, d in held.items()}


ODD = [
    None, "", " ", "  ", "a", "a▁b", "hello  world ", "\n\nx y\n", "<|endoftext|> is </s> plain <0x41> <unk>", "日本語 テキスト été", "x\x00y z", "a b c　d e", "\U0001f600 a\U0001f600b", "don't  we'll they've",
    "tab\tx y", "é a", "﻿bom x", "x\x1cy z", " lead", "trail ", "▁", "a ▁ b", "\x85 q", "x" * 3000, "1234567 89.5 -- ...", "a\r\nb c", "​zero  line",
]


def test_alignment_matches_a_loop(spark):
    rng = random.Random(9)
    words = ["the", "river", "unbelievable", "Straße", "xqzv", "don't", "3.14", "end.", "été", "tokenization"]
    rows = [(k, rng.choice([" ", " ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(30)]
    rows += [(100 + k, t) for k, t in enumerate(ODD)] + [(3, rows[3][1]), (None, "the river"), (None, "the river")]
    docs = spark.createDataFrame([(*r, *OTHERS) for r in rows], SCHEMA).repartition(4)
    want, pairs = aligned_by_loop(rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for most in (alignment.MOST_SENT_PAIRS, 0):
        found, counts = alignment.align_with_counts(docs, most=most)
        assert Counter(tuple(r[n] for n in names) for r in found.collect()) == Counter(want)
    assert {(r.a, r.b): r.docs for r in counts.collect()} == pairs
    assert alignment.align(docs.limit(0)).collect() == []


def test_pieces_tokenize_as_in_their_text():
    use = alignment.Tokenizers(alignment.definitions())
    for text in (t for t in ODD if t):
        parts = use.align(alignment.pieces(text))
        whole = use.align([text])
        if all(parts.good) and whole.good[0]:
            assert parts.shown and ";".join(parts.shown) == whole.shown[0] and parts.links.tolist() == whole.links.tolist()


def test_pairs_are_added_up_in_small_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 5} river {k % 3}") for k in range(200)], "doc_id long, text string").repartition(3)
    made_of = alignment.definitions()
    use = alignment.Tokenizers(made_of)
    found = alignment.linked(docs, made_of)
    plain = {tuple(r) for r in alignment.pair_counts(found, use.base, use.kind).collect()}
    pairs = Counter(p for r in found.collect() for p in np.frombuffer(r.pairs, use.kind).tolist())
    assert {(a * use.base + b, n) for a, b, _, n, _ in plain} == set(pairs.items())
