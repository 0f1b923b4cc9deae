"""The corpus operators against brute force on small tables, with nulls, ties, repeats and long texts."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import (
    bpe, chat, common, fingerprints, jaccard, links, packing, quality_model, quality_rules, sharding, toxicity, warc,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, score double, shard int, row long, label double, key string"


def _texts() -> list[str | None]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ß9") for _ in range(rng.randrange(1, 9)))
    plain = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    long_ = " ".join(word() for _ in range(30_000))
    near = [plain[3] + " tail", plain[3], plain[3], plain[5].replace(" ", "\n", 3)]
    odd = [None, "", "   \n", "a", "x<|endoftext|>y  z", "日本語 🎉🎉 text", "ab " * 400, "The THE the\nThe THE the\n"]
    return plain + [long_, long_ + " end"] + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i, t, "en", 0.5, 3, 1, 0.0, "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id", "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 3 != 0, i % 5 == 0) for i in range(45)], "doc_id long, quality boolean, toxic boolean"
    ).select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def _pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_longest_first_takes_the_least_loaded():
    jobs = [("a", 7), ("b", 5), ("c", 4), ("d", 4), ("e", 1)]
    assert sharding.longest_first(jobs, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards(docs, nothing):
    rows = sharding.document_shards(docs, 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in _pairs(docs)
    )
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for k, s in groups.items() if k[0] > 1)
    assert sharding.document_shards(nothing, 16).count() == 0


def _one_by_one(sizes, machines: int) -> list[list[int]]:
    """The sizes on each machine, when every job goes to the least-loaded one, largest first."""
    taken = [[] for _ in range(machines)]
    for size in sorted(sizes, reverse=True):
        taken[min(range(machines), key=lambda m: (sum(taken[m]), m))].append(size)
    return taken


def test_jobs_of_one_size_are_dealt_as_one_by_one():
    rng = random.Random(12)
    for trial in range(300):
        machines = rng.randrange(1, 9)
        classes = {rng.randrange(1, rng.choice([4, 30, 3000])): rng.randrange(1, rng.choice([3, 60])) for _ in range(rng.randrange(7))}
        if trial % 3 == 0:
            classes[50_000] = 1
        want = _one_by_one([s for s, n in classes.items() for _ in range(n)], machines)
        got = [[] for _ in range(machines)]
        for size, taken in sharding.classes_first(classes.items(), machines):
            assert sum(taken.values()) == classes[size]
            for m, n in taken.items():
                got[m] += [size] * n
        assert got == want, (classes, machines)
    assert dict(sharding.classes_first([(0, 5)], 3)) == {0: {0: 5}}
    assert dict(sharding.classes_first([(3, 10**12)], 4)) == {3: {m: 10**12 // 4 for m in range(4)}}


def test_shards_follow_the_schedule_of_all_groups(spark):
    rng = random.Random(13)
    texts = ["x" * rng.randrange(40) + str(rng.randrange(60)) for _ in range(900)] + ["the hot one"] * 500 + [None] * 3
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(7)
    rows = sharding.document_shards(docs, 5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    groups = Counter()
    for t in texts:
        groups[t] += len(t or "") + 1
    got = [Counter() for _ in range(5)]
    for r in rows:
        got[r.shard][texts[r.doc_id]] += r.size
    assert [sorted(g.values(), reverse=True) for g in got] == _one_by_one(groups.values(), 5)
    for shard in range(5):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_bpe_equals_the_library(docs, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in _pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(decoded)))
    got = [tuple(r) for r in bpe.digests(docs, VOCABULARY).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(nothing, VOCABULARY).count() == 0


def test_chat_costs_equal_brute_force(spark):
    rng = random.Random(2)
    names = ["system", "user", "assistant", "tool", None]
    rows, costs = [], {}
    for conv in range(60):
        roles = [rng.choice(names) for _ in range(rng.randrange(1, 6))]
        rows += [(conv, i, r, f"t{i}", "x") for i, r in enumerate(roles)]
        best = None
        moves = [chat._moves(chat.ROLES.get(r)) for r in roles]
        for choice in itertools.product(*[range(len(m)) for m in moves]) if len(roles) < 4 else ():
            state, cost = chat.START, 0
            for m, c in zip(moves, choice, strict=True):
                if m[c][0] != state:
                    break
                state, cost = m[c][1], cost + m[c][2]
            else:
                total = cost + chat._END[state]
                best = total if best is None else min(best, total)
        if best is not None:
            costs[conv] = best
    big = [(1000, i, rng.choice(names), None, "x") for i in range(3000)]
    table = spark.createDataFrame(rows + big, "conv_id long, turn long, role string, text string, cost string")
    got = chat.repaired(table).collect()
    assert len(got) == len(rows) + len(big)
    sums = Counter()
    for r in got:
        sums[r.conv_id] += r.cost
    assert all(sums[c] == cost for c, cost in costs.items())
    for conv in [*range(60), 1000]:
        pieces = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.turn)
        said = re.findall(r"<\|(system|user|assistant)\|>\n", "".join(r.piece for r in pieces))
        body = said[1:] if said[0] == "system" else said
        assert body == ["user", "assistant"] * (len(body) // 2)
    roles = [chat.ROLES.get(r[2]) for r in big]
    alone, _ = chat._forward(chat._begin(), roles)
    assert sums[1000] == min(alone[s] + chat._END[s] for s in range(4))
    assert chat.repaired(table.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rng = random.Random(1)
    bodies = [f"<p>{rng.random()}</p>\r\n\r\nWARC/1.0\r\n" for _ in range(20)] + [None, "", "é\n\n", "x" * 200_000]
    rows = [(i, f"http://a b/{i}", b, 1) for i, b in enumerate(bodies)]
    rows += [(100 + i, None, bodies[i % 3], 2) for i in range(9)] + [(5, "u", bodies[5], 3), (None, "", bodies[0], 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long").repartition(3)
    got = warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()
    digest = lambda b: base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
        (i, len((b or "").encode()), digest(b)) for i, _, b, _ in rows
    )
    first = {}
    for i, _, b, _ in rows:
        if i is not None:
            first[digest(b)] = min(i, first.get(digest(b), i))
    for d, least in first.items():
        same = [r for r in got if r.payload_digest == d]
        assert [r.page_id for r in same if r.record_type == "response"] == [least]
        assert all(r.refers_to == least for r in same if r.record_type == "revisit")
        assert all(r.refers_to is None for r in same if r.record_type == "response")
    small = warc.archive_round_trip(pages, f"file://{tmp_path}/v", min_bytes=10).collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 10)
    assert warc.archive_round_trip(pages.limit(0), f"file://{tmp_path}/n").count() == 0


def test_archives_end_at_their_size(spark, tmp_path):
    bodies = ["y" * 3000 + str(i % 40) for i in range(120)] + ["z" * 50_000, None, ""]
    rows = [(i, f"http://a/{i}", b) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    whole = warc.archive_round_trip(pages, f"file://{tmp_path}/one")
    cut = warc.archive_round_trip(pages, f"file://{tmp_path}/many", archive_bytes=20_000)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    for kind, records in (("arc", warc.arc_records), ("warc", warc.warc_records)):
        assert len(list(tmp_path.glob(f"one/{kind}/*/*.gz"))) <= 2
        files = list(tmp_path.glob(f"many/{kind}/*/*.gz"))
        assert len(files) > 10
        for f in files:
            sizes = [len(r[1]) for r in records(f.read_bytes())]
            assert sum(sizes[:-1]) < 21_000


def test_foreign_records_are_converted(spark, tmp_path):
    record = lambda url, kind, body: f"{url} 1.2.3.4 19990102030405 {kind} {len(body)}\n".encode() + body + b"\n"
    about = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    packed = record("filedesc://x.arc", "text/plain", about) + record("dns:a.b", "text/dns", b"1999\r\n\r\na.b A 1.2.3.4")
    packed += record("http://a/b c", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi") + record("ftp://a", "text/plain", b"")
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "x.arc.gz").write_bytes(gzip.compress(packed))
    none = spark.createDataFrame([], "file string, offset long, refers_id string, refers_to long")
    warc.convert(spark, f"file://{tmp_path}/arc", none, f"file://{tmp_path}/warc")
    (made,) = tmp_path.glob("warc/*/*.gz")
    got = [(f["warc-type"], f.get("warc-target-uri"), f["content-type"], f["warc-date"], b) for f, b in warc.warc_records(made.read_bytes())]
    assert [g[:3] for g in got] == [
        ("warcinfo", None, "application/warc-fields"), ("resource", "dns:a.b", "text/dns"),
        ("response", "http://a/b c", "application/http; msgtype=response"), ("resource", "ftp://a", "text/plain"),
    ]
    assert {g[3] for g in got[1:]} == {"1999-01-02T03:04:05Z"} and got[1][4] == b"1999\r\n\r\na.b A 1.2.3.4"
    back = warc.read_warc(spark, f"file://{tmp_path}/warc", "long").collect()
    assert [(r.payload_bytes, r.record_type) for r in back] == [(len(got[1][4]), "resource"), (2, "response"), (0, "resource")]


def test_rule_counts_equal_brute_force(docs, labels, nothing):
    got = quality_rules.assess(docs, labels).collect()
    want = []
    for i, text in _pairs(docs):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        marked = {j + k for j, w in enumerate(windows) if w in twice for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
        want.append((i, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked), failed))
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.assess(nothing, labels).count() == 0
    assert quality_rules.assess(docs, labels.limit(0)).count() == docs.count()


@pytest.mark.parametrize("operator", [quality_model.quality, toxicity.toxicity])
def test_scores_are_whole(docs, labels, nothing, operator):
    got = operator(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in _pairs(docs))
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert operator(nothing, labels).count() == 0
    assert operator(docs, labels.limit(0)).count() == docs.count()


def test_labelled_samples_hold_one_row_an_id(spark, monkeypatch):
    rows = [(i, f"text {i} of some words") for i in range(20)] + [(3, f"copy {j}") for j in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    seen = []
    fit, stored = quality_rules.fit, common.stored
    monkeypatch.setattr(quality_rules, "fit", lambda texts: seen.append(texts.count()) or fit(texts))
    monkeypatch.setattr(common, "stored", lambda df, name: seen.append(df.count()) or stored(df, name))
    quality_rules.assess(docs, labels)
    toxicity.fit(docs, labels, F.lit(True), "toxic", 100)
    assert seen == [20, 20]


def test_isotonic_rates():
    rates = common.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert rates.tolist() == [0, 0.5, 0.5, 1]


def test_disguises_are_undone():
    cube = np.zeros((64, 64, 64))
    text = " the idiot is a clown and stupid and the moron said so of the list idol diet " * 50
    codes = [toxicity.symbol(c) for c in text]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        cube[a, b, c] += 1
    decoder = toxicity.Decoder(cube)
    for word in ("1d10t", "i d i o t", "idiiiot", "i.d.i.o.t", "!diot"):
        assert "idiot" in decoder.restored(f"the {word} is"), word
    assert decoder.restored("Plain Words, 42% of $5") == "plain words, 42% of $5"


def test_disguises_at_borders_are_undone():
    cube = np.zeros((64, 64, 64))
    text = " the idiot is a loser, worthless and you hate the clown, a covid list of words " * 50
    codes = [toxicity.symbol(c) for c in text]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        cube[a, b, c] += 1
    decoder = toxicity.Decoder(cube)
    for word in ("idio7", '"1d1ot', "you,1diot", "1 d 1 0 t", "i   d   i   o   t", "1d10t!!"):
        assert "idiot" in re.findall(r"[a-z]+", decoder.restored(f"the {word} is")), word
    for word, plain in (("worthle$$", "worthless"), ("hat3", "hate"), ("(l0ser)", "loser"), ("l.0.s.3.r", "loser")):
        assert plain in re.findall(r"[a-z]+", decoder.restored(f"the {word} is")), word
    for word in ("covid19", "words!!", "(list", "1 2 3", "clown, 5"):
        assert decoder.restored(f"the {word} is") == f"the {word} is", word


def _jaccard(rows: list[tuple], k: int, percent: int) -> dict:
    sets, parent = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.append((i, own))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize(("k", "percent"), [(1, 90), (2, 80), (3, 90)])
def test_linked_groups_equal_brute_force(spark, docs, k, percent):
    rng = random.Random(k)
    rows = [r for r in _pairs(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))]
    for i in range(120):
        base = [rng.choice("abcdefgh") + str(rng.randrange(25)) for _ in range(rng.randrange(1, 45))]
        for _ in range(rng.randrange(1, 4)):
            w = list(base)
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            rows.append((len(rows) + 1000, " ".join(w[rng.randrange(2) :])))
    table = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, sid int").repartition(3)
    got = {r.row: r.component for r in jaccard.groups(table, k, percent).collect()}
    assert got == _jaccard(rows, k, percent)


def test_one_of_each_keeps_one_row_a_group(docs, nothing):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = _pairs(kept)
    want = _jaccard([r for r in _pairs(docs) if r[0] is not None], 5, 80)
    empty = {i for i, t in _pairs(docs) if not (t or "").strip()}
    assert Counter(i for i, _ in rows) == Counter({c for c in want.values()} | empty | {None})
    assert jaccard.one_of_each(nothing).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 620)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_components_settle_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(links, "RUN_LINKS", 2)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 2)
    try:
        hot = [(1000, 1000 + i) for i in range(1, 60)] + [(999, 1000)] + [(1059, 1)] + [(5, 2000), (6, 2000)]
        pairs = spark.createDataFrame(hot * 2, "a long, b long").coalesce(1)
        got = sorted(tuple(r) for r in links.components(pairs).collect())
    finally:
        spark.conf.set(size, before)
    assert got == [(1, 1), (5, 5), (6, 5), *((i, 1) for i in range(999, 1060)), (2000, 5)]


def test_packing_is_whole(docs, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    got = packing.packed(docs, VOCABULARY).collect()
    want = Counter()
    for i, t in _pairs(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids)] += len(ids)
    have = Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
    assert have == want
    texts = {i: t for i, t in _pairs(docs)}
    for r in got:
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sequences.values())
    assert max(sequences.values()) <= 2048 and padding < 0.01 * sum(sequences.values())
    assert packing.packed(nothing, VOCABULARY).count() == 0


def test_cutting_stock_takes_no_more_than_there_is():
    rng = random.Random(3)
    demand = {rng.randrange(1, 200): rng.randrange(1, 900) for _ in range(300)}
    taken, bins = Counter(), 0
    for pattern, uses in packing.cutting_stock(demand, 512):
        assert sum(s * n for s, n in pattern.items()) <= 512
        bins += uses
        for s, n in pattern.items():
            taken[s] += n * uses
    assert all(taken[s] <= n for s, n in demand.items())
    assert bins <= 1.01 * sum(s * n for s, n in demand.items()) / 512


def test_fingerprints_and_edited_texts(docs, nothing):
    got = fingerprints.neighbours(docs).collect()
    rows = [(i, t or "") for i, t in _pairs(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))]
    rows.sort(reverse=True)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, r)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in _pairs(docs))
    for (i, t), (_, n) in zip(rows[:-1], rows[1:], strict=True):
        if i == 0:
            continue
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = prints[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprints([t])[0]
        assert r.near_edited == fingerprints.likeness(r.fingerprint, fingerprints.fingerprints([edited])[0])
        assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprints([n])[0])
    assert fingerprints.neighbours(nothing).count() == 0


def test_a_repeated_id_is_dealt_to_many_tasks(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(9, "a"), (7, "text 0")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.neighbours(table).withColumn("task", F.spark_partition_id()).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert max(Counter(r.task for r in got).values()) < 200
    ordered = table.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()
    texts = [r.text for r in ordered]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    want = Counter(hashlib.sha256(e.encode()).hexdigest() for e in edited)
    assert Counter(r.edited_sha256 for r in got) == want


def test_walk_equals_one_step_at_a_time():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 300, 40] * 8 + [5_000]
    offsets = np.cumsum([0, *sizes])
    classes = rng.integers(0, 256, offsets[-1]).astype(np.uint8)
    steps, ends = fingerprints.walk(classes, offsets)
    for i, n in enumerate(sizes):
        t = 0
        for j in range(offsets[i], offsets[i] + n):
            assert steps[j] == t
            t += int(fingerprints._GAP[classes[j], t % fingerprints.PERIOD])
        assert ends[i] == t


def test_bands_reach_over_the_whole_text():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(5, 129))
        x = rng.integers(0, 256, n).astype(np.uint8)
        y = x.copy()
        y[: n // 5] += 1  # another opening
        a, b = ("00" + v.tobytes().hex() for v in (x, y))
        assert fingerprints.likeness(a, b) >= 0.8 and len({*fingerprints.band_keys(a)} & {*fingerprints.band_keys(b)}) > 1
        level, z = fingerprints.coarser(0, x)
        if len(z) >= 64:
            z = z.copy()
            z[: len(z) // 5] += 1
            c = f"{level:02d}" + z.tobytes().hex()
            assert fingerprints.likeness(a, c) >= 0.8 and len({*fingerprints.band_keys(a)} & {*fingerprints.band_keys(c)}) > 1
        cut = "00" + x[: -(n // 5) or None].tobytes().hex()
        assert {*fingerprints.band_keys(a)} & {*fingerprints.band_keys(cut)} or n < 5


def test_sketches_never_show_more_differences_than_there_are():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n, m = rng.integers(1, 129, 2)
        x = rng.integers(0, 256, n).astype(np.uint8)
        y = np.concatenate([x, rng.integers(0, 256, 128).astype(np.uint8)])[:m]
        y[rng.random(m) < rng.random()] += 1
        most = max(n, m)
        differ = most - int((x[: min(n, m)] == y[: min(n, m)]).sum())
        a, b = (fingerprints.sketch("00" + v.tobytes().hex()) for v in (x, y))
        shown = [((p ^ q) | (r ^ s)) & (1 << 64) - 1 for p, q, r, s in zip(a[:2], b[:2], a[2:4], b[2:4], strict=True)]
        assert (a[4], b[4]) == (n, m) and sum(bin(w).count("1") for w in shown) <= differ
    level, z = fingerprints.coarser(0, x)
    assert fingerprints.sketch("00" + x.tobytes().hex(), 1) == fingerprints.sketch(f"{level:02d}" + z.tobytes().hex())


def test_both_sketches_show_every_difference():
    """Two bits pass many strangers that agree in three quarters of the samples; all bits pass none."""
    rng = np.random.default_rng(10)
    for near in (0.74, 0.79, 0.8, 0.81):
        n = int(rng.integers(64, 129))
        x = rng.integers(0, 256, n).astype(np.uint8)
        y = x.copy()
        y[rng.permutation(n)[: n - int(near * n)]] ^= 0b100  # differs in a bit that the first sketch leaves out
        a, b = ("00" + v.tobytes().hex() for v in (x, y))
        words = [fingerprints.sketch(f)[:4] + fingerprints.finer_sketch(f) for f in (a, b)]
        differ = [p ^ q for p, q in zip(*words, strict=True)]
        shown = [0, 0]
        for i, word in enumerate(differ):
            shown[i % 2] |= word & (1 << 64) - 1
        assert not any(differ[:4])
        assert sum(bin(w).count("1") for w in shown) == int((x != y).sum())


def test_groups_of_borderline_fingerprints_are_those_of_all_pairs(spark):
    """Strangers that share a passage with a crowd of near copies, just under and just over the limit."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 256, 100).astype(np.uint8)
    found = []
    for differ in [3] * 70 + [19, 20, 21, 22, 23, 24] * 15:
        own = base.copy()
        own[40 + rng.permutation(60)[:differ]] ^= np.uint8(4 * rng.integers(1, 64))
        found.append("00" + own.tobytes().hex())
    table = spark.createDataFrame(list(enumerate(found)), "doc_id long, fingerprint string")
    got = {r.doc_id: r.near_id for r in fingerprints.near_groups(table).collect()}
    group = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if group[i] != group[j] and fingerprints.likeness(found[i], found[j]) >= fingerprints.NEAR:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert len(set(group)) > 5
    assert got == dict(enumerate(group))


def test_near_groups_find_edited_copies(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(400, 3000)))
        cut = rng.randrange(len(text))
        rows += [(3 * i, text), (3 * i + 1, text), (3 * i + 2, text[:cut] + "Z" + text[cut + 1 :])]
    prints = fingerprints.fingerprints([t for _, t in rows])
    table = spark.createDataFrame([(i, p) for (i, _), p in zip(rows, prints, strict=True)], "doc_id long, fingerprint string")
    got = {r.doc_id: r.near_id for r in fingerprints.near_groups(table).collect()}
    assert len(got) == len(rows)
    assert all(got[3 * i] == got[3 * i + 1] == 3 * i for i in range(60))
    assert sum(got[3 * i + 2] == 3 * i for i in range(60)) >= 54
    assert all(v // 3 == k // 3 for k, v in got.items())


def test_fingerprint_query_has_near_groups(spark, docs, tmp_path):
    from siftline.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_fingerprints(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in _pairs(docs))
    named = {r.doc_id: r.near_id for r in got}
    assert named[None] is None and named[43] == named[44] == 3 and named[7] == 7


def test_near_fingerprints_share_one_of_their_first_blocks():
    """In any order of the keys, at the limit, with partners of other sizes and of the next level."""
    rng = np.random.default_rng(13)
    met = 0
    for _ in range(1_500):
        n = int(rng.integers(3, 129))
        x = rng.integers(0, 4, n).astype(np.uint8)
        level, y = (0, x.copy()) if rng.random() < 0.6 else fingerprints.coarser(0, x)
        longer = int(rng.integers(0, len(y) // 4 + 1))
        y = np.concatenate([y, rng.integers(0, 4, longer).astype(np.uint8)])[:128]
        y[rng.permutation(len(y))[: rng.integers(0, len(y) // 5 + 1)]] += 1
        if level and len(y) < fingerprints.SAMPLES:
            continue
        a, b = "00" + x.tobytes().hex(), f"{level:02d}" + y.tobytes().hex()
        if a == b or fingerprints.likeness(a, b) < fingerprints.NEAR:
            continue
        met += 1
        for salt in range(1, 4):
            first = [
                {k for enough, own in fingerprints.blocks(f) for k in sorted(own.tolist(), key=lambda k: hash((salt, k)))[:enough]}
                for f in (a, b)
            ]
            assert first[0] & first[1], (n, len(y), level)
    assert met > 300


def test_strangers_of_a_crowd_are_told_apart_by_few_keys(spark, monkeypatch):
    """Keys of a class grow with the cells that may differ, not with the pairs of bands it shares with the crowd."""
    rng = np.random.default_rng(14)
    base = rng.integers(0, 256, 100).astype(np.uint8)
    found = []
    for differ in [3] * 150 + [26, 27, 28] * 20:
        own = base.copy()
        own[rng.permutation(100)[:differ]] ^= rng.integers(1, 256, differ).astype(np.uint8)
        found.append("00" + own.tobytes().hex())
    held = []
    whole = common.stored

    def stored(df, name):
        out = whole(df, name)
        if name == "near-apart":
            held.append(out.count())
        return out

    monkeypatch.setattr(common, "stored", stored)
    table = spark.createDataFrame(list(enumerate(found)), "doc_id long, fingerprint string")
    got = {r.doc_id: r.near_id for r in fingerprints.near_groups(table).collect()}
    group = list(range(len(found)))
    for i, j in itertools.combinations(range(len(found)), 2):
        if group[i] != group[j] and fingerprints.likeness(found[i], found[j]) >= fingerprints.NEAR:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    assert got == dict(enumerate(group))
    assert len(held) == 2 and held[0] > 0 and held[1] < held[0] / 2


@pytest.mark.parametrize("hot", [64, 4])
def test_near_groups_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "HOT_BAND", hot)
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 256, 100).astype(np.uint8)
    prints = []
    for i in range(30):  # different texts with a long common passage, and a near copy of each
        x = passage.copy()
        x[rng.permutation(100)[:30]] = rng.integers(0, 256, 30)
        y = x.copy()
        y[rng.permutation(100)[: 1 + i % 22]] += 1
        prints += ["03" + v.tobytes().hex() for v in (x, y)]
    for n in rng.integers(1, 12, 60):  # short ones
        prints.append("00" + rng.integers(0, 3, n).astype(np.uint8).tobytes().hex())
    rows = [(i // 2 if i < 4 else i, p) for i, p in enumerate(prints)]  # ids may repeat
    table = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if group[i] != group[j] and fingerprints.likeness(prints[i], prints[j]) >= 0.8:
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    got = {r.fingerprint: r.near_id for r in fingerprints.near_names(table).collect()}
    assert got == {p: least[g] for p, g in zip(prints, group, strict=True)}


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    pieces = corpus_pipeline.run(spark, sf).collect()
    docs = dict(_pairs(spark.read.parquet(f"{sf}/documents.parquet")))
    kept = {p.doc_id for p in pieces}
    assert 0 < len(kept) < len(docs)
    groups = _jaccard(sorted((i, docs[i]) for i in kept), 5, 80)
    assert all(i == c for i, c in groups.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for operator, label in ((quality_model.quality, "quality"), (toxicity.toxicity, "toxic")):
        rows = operator(docs, labels).join(labels, "doc_id").where("held_out").collect()
        right = sum(r["predicted"] == r[label] for r in rows) / len(rows)
        assert right >= 0.93, (label, right)


@pytest.mark.parametrize("sign", list("!|$+(@0-._* "))
def test_runs_of_signs_take_linear_time(sign):
    decoder = toxicity.Decoder(np.ones((64, 64, 64)))
    for end in ("", " ", "\n"):
        assert decoder.restored(sign * 200_000 + end) == sign * 200_000 + end


@pytest.mark.parametrize("marks", [[], [0] * 30, [1] * 30])
def test_labels_of_one_kind_reject_nothing(spark, docs, marks):
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    assert toxicity.kept(docs, labels).count() == docs.count()
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels).collect()} == {0}


def test_fingerprints_take_ids_of_any_type(docs):
    want = {r["fingerprint"] for r in fingerprints.neighbours(docs).collect()}
    for kind in ("smallint", "decimal(20,0)", "string"):
        found = fingerprints.neighbours(docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
        assert found.schema["doc_id"].dataType.simpleString() == kind
        assert {r["fingerprint"] for r in found.collect()} == want
