import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftline.llm import alignment, byte_encoding, collocations, packing, vectors
from siftline.llm.bpe import byte_letters

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, slice int, pair int, n int"


def documents(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, 7, 8, 9) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return spark.createDataFrame(rows, DOCS)


# Collocations ---------------------------------------------------------------------------


def collocations_by_hand(texts, langs, support, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in zip(texts, langs, strict=True):
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(fold)):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang or "und"] += len(words)
            for k in range(1, 6):
                counts[lang or "und"].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        often = {p: n for p, n in found.items() if len(p) > 1 and n >= support}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and n >= a and inside(p, q) for q, n in often.items()):
                continue
            cuts = [(found[p[:k]], found[p[k:]], k) for k in range(1, len(p))]
            score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for x, y, k in cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 4])
def test_collocations_equal_brute_force(spark, shards):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Émile", "été", "a b", "X-Y", "zz\x00z"]
    weights = [1 / (i + 1) for i in range(len(words))]
    line = "the same passage is in many documents"
    texts, langs = [], []
    for i in range(240):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choices(words, weights)[0])
            parts.append(rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "!?", "\x0b"]))
        texts.append("".join(parts) + (line.upper() if i % 3 else line))
        langs.append(rng.choice(["en", "en", "de", None]))
    texts += [None, "", " \t", ".,;", "one", *["of of of of of of of"] * 20]
    langs += ["en", None, "fr", "en", "xx", *["de"] * 20]
    df = documents(spark, texts, langs).repartition(6)
    got = sorted(tuple(r) for r in collocations.collocations(df, support=12, top=50, shards=shards).collect())
    want = collocations_by_hand(texts, langs, 12, 50)
    assert len(want) > 40
    assert got == want


def test_collocations_of_nothing(spark):
    for texts in ([], [None, ""], ["a b c"]):
        assert collocations.collocations(documents(spark, texts)).collect() == []


def test_a_very_long_piece_and_score_beyond_64_bits(spark):
    texts = ["a b " * 60_000, " ".join(f"x{i}" for i in range(50_000))]
    got = [tuple(r) for r in collocations.collocations(documents(spark, texts), support=50_000).collect()]
    assert got == collocations_by_hand(texts, ["en", "en"], 50_000, 2000)
    row = "CAST(1000 * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) AS DECIMAL(38,0)) DIV CAST(a AS DECIMAL(19,0))"
    assert spark.range(1).selectExpr("CAST(9000000000000000 AS LONG) AS a").selectExpr(row).first()[0] == 9 * 10**18


# Near vectors ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, node int, unit string"


def components_by_hand(pairs, ids):
    above = {i: i for i in ids}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_by_hand(data, near):
    links, pairs = Counter(), []
    for i, (a, x, lx) in enumerate(data):
        for b, y, ly in data[i + 1 :]:
            if a is None or b is None or lx is None or lx != ly or x is None or y is None or len(x) != len(y):
                continue
            if any(v is None or not math.isfinite(v) for v in x + y) or not any(x) or not any(y):
                continue
            cosine = sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
            if cosine >= near:
                links.update((a, b))
                pairs.append((a, b))
    ids = [a for a, _, _ in data if a is not None]
    part = components_by_hand(pairs, ids)
    return sorted((a, links[a], part[a], part[a] == a) for a in ids)


def crowd(rng, centre, n, noise):
    return [(centre + noise * rng.normal(size=len(centre))).tolist() for _ in range(n)]


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    made = []
    for label in (0, 1):
        for noise, n in ((0.001, 40), (0.02, 40), (0.03, 30), (0.1, 20)):
            made += [(v, label) for v in crowd(rng, rng.normal(size=16) / 2, n, noise)]
        made += [(v, label) for v in rng.normal(size=(40, 16)).tolist()]
    made += [(made[0][0], 0)] * 5 + [(made[0][0], 1), ([2 * x for x in made[0][0]], 0)]
    order = rng.permutation(len(made)).tolist()
    data = [(100 + i, *made[k]) for i, k in enumerate(order)]
    data += [
        (1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] * 16, 0), (4, [None] + [1.0] * 15, 0), (5, [], 0),
        (6, [1.0, 2.0], 0), (7, [2.0, 4.0], 0), (8, [1e300] * 3, 0), (9, [1e-300] * 3, 0), (10, made[0][0], None),
        (11, [float("inf")] + [1.0] * 15, 0),
    ]
    df = spark.createDataFrame([(*r, 0, "u") for r in data] + [(None, made[0][0], 0, 0, "u")], VECTORS)
    got = [tuple(r) for r in vectors.near_vectors(df).collect()]
    assert sorted(r for r in got if r[0] is not None) == near_by_hand(
        [(a, [x * 1e150 for x in v] if a == 9 else [x / 1e150 for x in v] if a == 8 else v, c) for a, v, c in data], 0.98
    )
    assert [r for r in got if r[0] is None] == [(None, 0, None, False)]


def test_many_cells_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_UNITS", 2)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.default_rng(9)
    data = []
    for _ in range(120):
        centre = rng.normal(size=24)
        data += crowd(rng, centre, 6, 0.12)
    df = spark.createDataFrame([(i, v, 1, 0, "u") for i, v in enumerate(data)], VECTORS)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df).collect()}
    want = {a: n for a, n, _, _ in near_by_hand([(i, v, 1) for i, v in enumerate(data)], 0.98)}
    assert sum(want.values()) > 500
    assert all(got[a] <= n for a, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_cells_come_nearest_first():
    rng = np.random.default_rng(1)
    a, b = rng.random(12), rng.random(9)
    cells = vectors.nearest_cells(a, b, 0.9)
    bounds = [a[i] + b[j] for i, j in cells]
    assert bounds == sorted(bounds)
    assert set(cells) == {(i, j) for i in range(12) for j in range(9) if a[i] + b[j] <= 0.9}


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


# Alignment ------------------------------------------------------------------------------


def aligned_by_hand(texts):
    a_side = Tokenizer.from_file(VOCABULARY)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = byte_letters()
    raw_a = {i: bytes(letters[c] for c in t) for t, i in a_side.get_vocab().items() if t != "<|endoftext|>"}
    pieces = [b_side.id_to_piece(i) for i in range(b_side.get_piece_size())]
    raw_b = [bytes([int(p[3:-1], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    found, counts = [], Counter()
    for text in texts:
        sides = [], []
        if text:
            sides = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            if any(b"".join(raw[i] for i in ids) != (" " + text).encode() for raw, ids in zip((raw_a, raw_b), sides)):
                sides = [], []
        spans = []
        for raw, ids in zip((raw_a, raw_b), sides):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(raw[i]), i))
                at += len(raw[i])
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links, groups, i, j = Counter(), [], 0, 0
        for end in ends:
            p, q = i, j
            while p < len(spans[0]) and spans[0][p][1] <= end:
                p += 1
            while q < len(spans[1]) and spans[1][q][1] <= end:
                q += 1
            groups.append("|".join(",".join(str(x[2]) for x in own) for own in (spans[0][i:p], spans[1][j:q])))
            links.update((x[2], y[2]) for x in spans[0][i:p] for y in spans[1][j:q] if x[0] < y[1] and y[0] < x[1])
            i, j = p, q
        counts.update(links.keys())
        found.append((len(spans[0]), len(spans[1]), groups, links))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, (n_a, n_b, groups, links) in enumerate(found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        good = sum(n for p, n in links.items() if counts[p] == best[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), good, total, digest))
    return out


TEXTS = [
    None, "", " ", "a", "The quick brown fox.", "The quick brown fox.", "naïve café — 你好, мир 🙂", "<|endoftext|> is text",
    "a ▁ b", "\u0000\u0001", "x" * 300, "    indented\n\n\ttabs  and   spaces", "<0x41> </s> <s>", "ﬁ ½ Å", "1234567890 3.14",
    "𝒳 é​﻿", "word " * 500,
]


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "tion", "Straße", "größer", "niño", "über", "π", "don't", "I'll", "foo_bar", "HTTPServer", "  ", "\n", "x1y2", "😀"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 200))) for _ in range(60)]
    monkeypatch.setattr(alignment, "SLICES_A_TASK", 2)
    out = alignment.aligned(documents(spark, texts).repartition(5), VOCABULARY, PIECES)
    assert sorted(tuple(r) for r in out.collect()) == aligned_by_hand(texts)


def test_alignment_of_no_documents(spark):
    assert alignment.aligned(documents(spark, []), VOCABULARY, PIECES).collect() == []
    out = alignment.aligned(documents(spark, [None, ""]), VOCABULARY, PIECES)
    assert sorted(tuple(r) for r in out.collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(2)]


def test_groups_end_where_both_sides_do():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(1, 80)
        common = set(rng.sample(range(1, n + 1), rng.randrange(1, n + 1))) | {n}
        a = sorted(common | {x for x in range(1, n) if rng.random() < 0.2})
        b = sorted(common | {x for x in range(1, n) if rng.random() < 0.2})
        ends = sorted(set(a) & set(b))
        got = alignment.group_ends(a, b)
        assert got[0].tolist() == [a.index(e) + 1 for e in ends]
        assert got[1].tolist() == [b.index(e) + 1 for e in ends]
    assert [x.tolist() for x in alignment.group_ends([], [])] == [[], []]


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "word" + " " * 1_200_000 + "\t", "　" * 1_100_000])
def test_long_white_space_is_encoded(run):
    with open(VOCABULARY, encoding="utf-8") as f:
        definition = f.read()
    for specials in (True, False):
        encoder = byte_encoding.encoder(definition, specials)
        ids = encoder.ids(f"before{run}after <|endoftext|>")
        assert b"".join(encoder.raw[ids]) == f"before{run}after <|endoftext|>".encode()
        assert (50256 in ids) == specials
    # the same rule on a run that the compiled encoder takes
    short = f"before{run[:70_000]}after"
    assert encoder.ids(short) == encoder._compiled.encode_ordinary(short)


def test_ids_of_texts_come_as_arrays_without_a_list(monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    with open(VOCABULARY, encoding="utf-8") as f:
        definition = f.read()
    rng = random.Random(4)
    letters = "abXY01 \t\n\r\x0b\x85\xa0\u3000's'rellvemd.,;\u00e9\u4e2d\u0661\u00b2\u0301\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(500)]
    texts += ["", "a<|endoftext|>b", "x" * 70_000, "." * 70_000, "a" + " " * 60_000 + "b", "\u4e2d" * 70_000]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    long_space = "a" + " " * byte_encoding.LONG_SPACE
    longest = byte_encoding.encoder(definition, True).ids(long_space)
    assert packing.token_ids(definition, long_space).tolist() == [*longest, packing.END_ID]
    monkeypatch.setattr(byte_encoding.ByteEncoder, "ids", lambda *_: pytest.fail("a list of ids was made"))
    for text, ids in zip(texts, wanted, strict=True):
        got = packing.token_ids(definition, text)
        assert got.dtype == np.dtype("<u4") and got.tolist() == [*ids, packing.END_ID]
