"""The ten operators on small fixtures: against brute force, exact round trips, and the awkward cases of each."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from docloom.llm import ann, chat, html, media, mixing, packing, simhash, substring, toxicity, warc
from docloom.llm.common import freed

DOCS = "doc_id long, text string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijk") for _ in range(RNG.randint(1, 6))) for _ in range(400)] + ["été", "Ünï", "the"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    base, passage = prose(300, 1), prose(70, 2)
    rows = [(i, prose(20 + 13 * i, 100 + i)) for i in range(12)]
    rows += [(20, base), (21, base), (22, base.upper()), (23, base.replace(VOCAB[3], "changed")), (24, base + " tail of words"), (25, "lead " + base)]
    rows += [(30 + i, prose(30, 50 + i) + "\n\n" + passage + "\t" + prose(45, 70 + i)) for i in range(5)]
    rows += [(40, "spam " * 200), (41, "spam " * 120 + "end"), (42, "a b " * 90), (43, "x a b " * 40), (44, prose(49, 9)), (45, prose(49, 9)), (46, prose(50, 10)), (47, prose(50, 10))]
    rows += [(50, None), (51, ""), (52, " \n "), (None, base), (60, passage), (60, passage), (61, "one"), (62, "One"), (63, prose(4000, 11) + " " + passage)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("begin", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3).cache()


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# -- 1 ----------------------------------------------------------------------------------------------------


def test_substring_equals_brute_force(docs):
    assert tuples(substring.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(corpus())


def test_substring_window_and_removal(spark, docs):
    got = substring.remove(docs)
    assert got.columns == docs.columns and got.count() == len(corpus())
    sizes = dict(tuples(substring.digest(docs).where("doc_id < 60").select("doc_id", (F.col("n_words") - F.col("n_removed")).alias("n")), "doc_id", "n"))
    assert {r.doc_id: len((r.text or "").split()) for r in got.where("doc_id < 60").collect()} == sizes
    assert got.where("doc_id = 20").first().text == dict(corpus())[20]
    assert substring.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_long_document_in_pieces_equals_whole(monkeypatch):
    words = prose(6000, 3).encode()
    data = np.frombuffer(words, np.uint8)
    hashes = substring.document_hashes(data)
    whole = substring.segments(hashes, np.array([0, len(hashes)]))
    monkeypatch.setattr(substring, "CHUNK_WORDS", 500)
    monkeypatch.setattr(substring, "CHUNK_BYTES", 1000)
    assert (substring.document_hashes(data) == hashes).all()
    keys = {}
    for key, _, _, begin, n in substring._long_segments(hashes, 50):
        for k, b, m in zip(key, begin, n, strict=True):
            keys.update(dict.fromkeys(range(b, b + m), k))
    want = {p: k for k, b, m in zip(whole[0], whole[3], whole[4], strict=True) for p in range(b, b + m)}
    assert keys == want


def test_symbols_inside_equal_substrings_agree():
    common = [hash(w) & (1 << 63) - 1 for w in prose(200, 4).split()]
    sides = [[hash(w) & (1 << 63) - 1 for w in prose(40, s).split()] for s in (5, 6)]
    seen = []
    for side in sides:
        h = np.array(side + common + side, np.uint64)
        every = []
        for name, start, left, right in substring.recompress(h, np.array([0, len(h)])):
            inside = (left >= len(side)) & (right <= len(side) + len(common))
            every.append(list(zip(name[inside].tolist(), start[inside].tolist(), strict=True)))
        seen.append(every)
    assert seen[0] == seen[1] and all(len(x) > 10 for x in seen[0])
    sizes = [len(x) for x in seen[0]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0] / 2.5  # symbols of the last rounds stand for several words


def test_names_reveal_the_repeats(spark, docs, monkeypatch):
    """Names that differ between documents find nothing; names of single words make no symbol of the last rounds."""
    real = substring.recompress
    count = lambda: substring.digest(docs).agg(F.sum("n_removed")).first()[0]
    want = count()

    def salted(hashes, first, rounds=substring.ROUNDS):
        salt = np.repeat(np.arange(len(first) - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.diff(first))
        return real(hashes ^ salt, first, rounds)

    h = substring.document_hashes(np.frombuffer(prose(3000, 12).encode(), np.uint8))
    keys = len(np.unique(substring.window_keys(h, np.array([0, len(h)]))))
    monkeypatch.setattr(substring, "recompress", salted)
    assert count() < want / 2
    monkeypatch.setattr(substring, "recompress", lambda h, first, rounds=5: ((h, np.arange(len(h)), np.arange(len(h)), np.arange(len(h)) + 1) for _ in range(rounds + 2)))
    assert len(np.unique(substring.window_keys(h, np.array([0, len(h)])))) < keys / 2


def test_window_keys_equal_plain_ones():
    r = random.Random(4)
    words = [r.choice(["a", "b", "c d", "e f g"]) if r.random() < 0.3 else r.choice(VOCAB) for _ in range(400)] + ["z"] * 120
    h = np.array([hash(w) & (1 << 63) - 1 for w in " ".join(words).split()], np.uint64)
    first = np.array([0, 150, 150, len(h)])
    want = np.zeros(len(h), np.uint64)
    for k, (name, _, left, right) in enumerate(substring.recompress(h, first)):
        for x, a, b in zip(name, left, right, strict=True):
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                if k > substring.ROUNDS + 1 - substring.LAST_ROUNDS and a >= lo and b <= hi:
                    for p in range(max(b - 50, lo), min(a, hi - 50) + 1):
                        want[p] = max(want[p], np.uint64(k + 1) << np.uint64(58) | substring.mix64(x[None])[0] >> np.uint64(6))
    assert (substring.window_keys(h, first) == want).all() and (want > 0).mean() > 0.5


def test_remove_keeps_columns_of_any_name(spark):
    shared = prose(60, 300)
    rows = [(1, shared, "x", [1], 5, 6, 7, 8), (2, "own " + shared, None, None, 5, 6, 7, 8), (None, shared, "y", [2], 5, 6, 7, 8), (3, None, "z", [], 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spans array<int>, _id int, _print int, row int, `c0` int")
    got = {r.doc_id: tuple(r) for r in substring.remove(df).collect()}
    assert got == {1: rows[0], 2: (2, "own", None, None, 5, 6, 7, 8), None: rows[2], 3: rows[3]}


# -- 2 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kw", [{}, {"tile": 3, "agree": 1}, {"agree": 3}])
def test_simhash_equals_brute_force(docs, kw):
    assert tuples(simhash.near_duplicates(docs, **kw), "doc_id", "fingerprint", "component_id") == brute.simhash(corpus())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_tiles_are_skipped_by_bit_counts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    simhash.fingerprints(docs).select("fp").distinct().write.parquet(str(tmp_path / "fps"))
    classes = spark.read.parquet(str(tmp_path / "fps"))
    tiles = simhash.make_tiles(classes)
    assert tiles.where("exists(fps, x -> bit_count(x) <> bits)").isEmpty()
    gaps = simhash.tile_pairs(tiles).agg(F.count_if(F.col("gap") > 4), F.count_if(F.col("gap") <= 4)).first()
    assert gaps[0] > 0 and gaps[1] > 0


def test_tiles_keep_components():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(k)) for k in r.integers(0, 60, 9))]))
    links = simhash.compare_tiles(near, None, 2)
    assert len(links) == len(near) - len(base)
    left, right = near[::2], near[1::2]
    assert all((a ^ b).bit_count() <= 2 for a, b in simhash.compare_tiles(left, right, 2))
    assert len(simhash.tables(4, 1)) == 5 and sum(simhash.tables(4, 1)) == (1 << 64) - 1 and len(simhash.tables(4, 2)) == 15


@pytest.mark.parametrize("tile", [2048, 2])
def test_similar_equals_brute_force(spark, tile):
    base = prose(200, 77).split()
    rows = [r for r in corpus() if r[0] is not None and r[0] != 60]
    for k in range(8):
        w = list(base)
        w[10 + 20 * k] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    got = simhash.similar(spark.createDataFrame(rows, DOCS), tile=tile)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute.similar(rows)


def test_representatives_come_by_their_fingerprints(spark, monkeypatch):
    """Documents that share no band meet by fingerprints within the radius, tile by tile, and are then checked by their sets."""
    base = prose(900, 78).split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join([*base[:400], "edit", *base[401:]])), (4, prose(900, 79)), (5, None), (6, ""), (7, "spam " * 200), (8, "spam " * 200 + "end")]
    bits = [simhash.fingerprint(t.encode()) for _, t in rows[:3]]
    assert len(set(bits)) > 1 and max((bits[0] ^ b).bit_count() for b in bits) <= 4
    own, linked = simhash.links, []
    monkeypatch.setattr(simhash, "bands", lambda hashes: np.empty(0, np.uint64))
    monkeypatch.setattr(simhash, "links", lambda *a, **kw: linked.append(own(*a, **kw)) or linked[-1])
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8} and len(linked) == 1
    assert sorted(r.doc_id for r in simhash.keep_representatives(df).collect()) == [1, 4, 5, 7, 8]


def test_representatives(spark, docs):
    kept = simhash.keep_representatives(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 20 in ids and 21 not in ids and ids.count(60) == 1 and not {51, 52} & set(ids)
    assert simhash.keep_representatives(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_at_the_limit_are_decided_by_their_sets():
    r = np.random.default_rng(6)
    for n in (4, 12, 400):
        whole = np.unique(r.integers(0, 1 << 32, n + n // 4, dtype=np.uint32))
        part = np.sort(r.permutation(whole)[:n])
        other = np.unique(r.integers(0, 1 << 32, n, dtype=np.uint32))
        assert simhash.link_similar(np.array([1, 2, 3]), [whole, part, other], 0, 0.8) == [(1, 2)]
        assert simhash.link_similar(np.array([1, 2, 3]), [part, whole, other], 1, 0.8) == [(1, 2)]


def test_short_pairs_whose_fingerprints_differ_link(spark):
    rows = []
    for k in range(1500):
        words = [f"q{k}x{j}" for j in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[2 * k + 1] == got[2 * k] == 2 * k for k in range(1500))


def test_representatives_of_shared_and_null_ids(spark):
    a, b, c, d = (prose(60, k) for k in (201, 202, 203, 204))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (5, c, "x"), (5, d, "y"), (5, d, "x"), (7, d + " tail", "x"), (3, c.upper(), "x")]
    rows += [(None, d + " end", "x"), (9, None, "x"), (9, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted([(None, a, "x"), (None, b, "x"), (3, c.upper(), "x"), (5, d, "x")], key=str)
    for k in (1, 5):
        got = tuples(simhash.keep_representatives(df.repartition(k)), "doc_id", "text", "source")
        assert [r for r in got if r[0] != 9] == want and len(got) == 5


# -- 3 ----------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a.b/x", "<p>é</p>"), (2, "http://a.b/y z\r\nX: 1", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (None, "u", "<p>é</p>"), (7, "v", "long " * 9000), (7, "v", "long " * 9000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages, "file://" + str(tmp_path / "w")).collect()}
    assert got == {(1, 9, "revisit", 2), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 18, "response", None), (None, 9, "revisit", 2), (7, 45000, "response", None)}
    back = warc.read(spark, "file://" + str(tmp_path / "w"), with_payload=True).where("record_type = 'response'").collect()
    want = {(i or "").encode() for _, _, i in PAGES}
    assert {bytes(r.payload) for r in back} == want
    for r in back:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()


def test_archives_have_a_gzip_member_for_each_record(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" + "y" * (10 if i % 7 else 300_000)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("owner", F.lit(2)).repartition(3)
    assert warc.archive(pages, "file://" + str(tmp_path / "w")).where("record_type = 'response'").count() == 7
    n = 0
    for f in (tmp_path / "w").glob("part-*"):
        blob = f.read_bytes()
        import gzip

        assert gzip.decompress(blob).count(b"WARC/1.1\r\n") == sum(1 for _ in warc.parse(blob))
        for member in warc.members(memoryview(blob)):
            ((head, content),) = warc.parse(member)  # one record, which can be read alone
            assert int(head["content-length"]) == len(content)
            n += 1
    assert n == 60
    owners = spark.createDataFrame([("a", 100, 1000), ("b", 1, 10_000_000)], "digest string, copies long, size long")
    assert warc.records_per_file(owners, 1 << 20) == 1 and warc.records_per_file(owners.limit(0)) == (64 << 20) // 512


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(none, "file://" + str(tmp_path / "w")).count() == 0


# -- 4 ----------------------------------------------------------------------------------------------------


def mixed_rows():
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 300), i), f"s{r.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)]
    return rows + [(500, prose(30, 1), None), (501, None, "s1"), (502, "", None), (502, "", None), (503, prose(5000, 2), "s2")]


def test_mix_meets_targets(spark):
    df = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string").withColumn("target", F.lit(0))
    got = mixing.mix(df, block=16, shard_tokens=2000).collect()
    assert len(got) == len(mixed_rows())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        t = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0] += r.taken
        t[1] += r.size
    sizes = {s: t[1] for s, t in by.items()}
    assert all(t[1] == t[3] for t in by.values())
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, want = set(), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        want = {s: 2 * sizes[s] if s in capped else weight[s] * left / sum(weight[x] for x in rest) for s in order}
        over = [s for s in rest if want[s] > 2 * sizes[s]]
        if not over:
            break
        capped.update(over)
    for s, t in by.items():
        assert abs(t[2] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(t[0] - t[2]) <= 16 * (2 + t[3] // 2000 * 2 + 2)
    again = mixing.mix(df.repartition(5), block=16, shard_tokens=2000)
    assert tuples(again, "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=str)


def test_apportionment_is_sainte_lague(spark):
    votes = [53, 24, 23, 7, 1, 0]
    df = spark.createDataFrame([(i, v, 13) for i, v in enumerate(votes)], "party int, votes int, seats long")
    got = {r.party: r.won for r in mixing.apportion(df, [], "party", "votes", "seats", "won").collect()}
    quotients = sorted(((-v / (2 * k - 1), i) for i, v in enumerate(votes) if v for k in range(1, 40)))[:13]
    assert got == {i: sum(1 for _, p in quotients if p == i) for i in range(6)}


def test_mix_applied(spark):
    df = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.apply_mix(df, block=16)
    assert got.columns == df.columns
    assert max(r["count"] for r in got.where("doc_id < 502").groupBy("doc_id").count().collect()) == 2
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, prose(40, i % 90), f"s{i % 3}", [i], "x") for i in range(120)] + [(None, prose(30, 7), None, [1], None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `_print` array<int>, `_nth` string")
    for name in ("row", "times", "print", "due", "words", "part", "upto", "shard", "key", "size", "taken"):
        df = df.withColumn(name, F.lit(name))
    got = mixing.apply_mix(df, block=16)
    assert got.columns == df.columns and {(r.doc_id, r.text, r.source, tuple(r._print), r.row) for r in got.collect()} <= {(*r[:3], tuple(r[3]), "row") for r in rows}
    assert mixing.mix(df).columns == ["doc_id", "print", "size", "source", "source_size", "target", "taken"] and mixing.apply_mix(df.limit(0)).count() == 0


def test_representatives_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, None, 3)], "doc_id long, text string, hash int")
    for name in ("row", "id", "least", "_hash", "_row", "best_id", "print", "band", "root", "bands"):
        df = df.withColumn(name, F.lit(name))
    got = simhash.keep_representatives(df)
    assert got.columns == df.columns and {(r.doc_id, r.hash, r.root) for r in got.collect()} == {(1, 1, "root"), (3, 3, "root")}


def test_mix_keeps_small_sources(spark):
    rows = [(i, "w " * 900, "a") for i in range(30)] + [(100 + i, "x " * n, f"s{i}") for i, n in enumerate((1, 9, 30, 63, 100, 500, 1500))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.first("source_size").alias("n")).collect()
    assert len(got) == 8 and all(abs(x.t - x.w) <= max(1, x.n / 32) for x in got if x.source != "a")


def test_mix_of_long_documents_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, f"w{i} " * r.randint(2000, 5000), f"s{i % 3}") for i in range(240)] + [(300, "again " * 700, "s1")] * 3 + [(300, "again " * 700, "s2"), (301, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.8, 1.2):
        want = {x.source: (x.target, x.source_size) for x in mixing.mix(df, share=share).select("source", "target", "source_size").distinct().collect()}
        kept = {}
        for x in mixing.apply_mix(df, share=share).collect():
            kept[x.source] = kept.get(x.source, 0) + len(x.text.split())
        assert share > 1 or min(t / n for t, n in want.values()) < 0.45
        assert all(abs(kept.get(s, 0) - t) <= 2500 + 2 * 256 for s, (t, _) in want.items())


# -- 5 ----------------------------------------------------------------------------------------------------


def vectors(spark, n=1200, dim=16):
    r = np.random.default_rng(2)
    x = r.standard_normal((n, dim)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(50)] + [(5000, None), (5100, [0.0] * dim), (5200, [float("nan")] * dim), (5300, [None] * dim), (5400, [1.0]), (None, rows[1][1]), (5500, rows[5][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_search_is_exact_when_it_reads_all(spark):
    rows, df = vectors(spark)
    got = {}
    for r in ann.search(df, centroids=8, probe=1).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute.nearest([r for r in rows if r[0] != 5400])


def test_search_recall(spark):
    rows, df = vectors(spark, 4000)
    got = {}
    for r in ann.search(df, every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute.nearest([r for r in rows if r[0] != 5400], every=50)
    hit = [len(got[q] & set(w)) / len(w) for q, w in want.items()]
    assert set(got) == set(want) and np.mean(hit) >= 0.9


def test_search_recall_by_probe(spark):
    """Vectors in clusters: a small share of them holds the nearest."""
    r = np.random.default_rng(8)
    middle = r.standard_normal((60, 16))
    x = middle[r.integers(0, 60, 3000)] + 0.15 * r.standard_normal((3000, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("i", F.lit(None))
    want = brute.nearest(rows)
    recall = {}
    for probe in (0.01, 0.1):
        got = {}
        for x in ann.search(df, probe=probe).collect():
            got.setdefault(x.query_id, set()).add(x.vec_id)
        recall[probe] = np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()])
    assert recall[0.1] >= 0.99 and recall[0.01] >= 0.7
    assert [ann.centroids_for(n) for n in (1, 500, 51_000, 10**9)] == [128, 128, 128, 1024]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_search_recall_on_tables(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    want, got = brute.nearest([(r.vec_id, r.embedding) for r in df.collect()]), {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_search_beside_many_rows_of_one_id(spark):
    rows = [(0, [1.0, float(i) / 100]) for i in range(40)] + [(i, [0.0, float(i)]) for i in range(1, 13)]
    got = [r.vec_id for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probe=0.01).orderBy("rank").collect()]
    assert got == list(range(1, 11))


def test_search_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 4, 0.0), (0, 2, 3, 1.414214)]
    assert ann.search(few.limit(0)).count() == 0


def test_queries_and_sample_stay_off_the_driver(spark, monkeypatch):
    """Queries are copied to every block they reach, which Spark's estimate doesn't see: they are never broadcast."""
    _, df = vectors(spark)
    got = ann.search(df)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() > 0
    held = ann.sound(df).where("size(v) = 16")
    want = held.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(100).select("v").toArrow().column("v")
    assert ann.sampled(held, 1251, 100).equals(want) and ann.sampled(held, 10**6, 100).equals(want)
    x = np.random.default_rng(3).standard_normal((50, 4))
    monkeypatch.setattr(ann, "ASSIGNED", 7)
    assert ann.assign(x, x[:9]).tolist() == [int(np.argmin(((x[:9] - y) ** 2).sum(axis=1))) for y in x]


def test_walk_visits_cells_by_sum():
    counts = np.array([[1, 0, 2], [3, 1, 0]])
    first, second = np.array([0.5, 0.1]), np.array([0.3, 0.0, 0.9])
    assert ann.reach(first, second, counts, 1) == pytest.approx(0.1) and ann.reach(first, second, counts, 4) == pytest.approx(0.4)
    assert ann.reach(first, second, counts, 100) == pytest.approx(1.4)


# -- 6 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 36863, 36864, 36865, 36864 * 17 + 5])
def test_transport_stream_round_trip(n):
    payload = media.pad(random.Random(n).randbytes(n))
    stored = media.mux(payload)
    back = media.demux(stored)
    assert back.payload == payload and len(stored) % 188 == 0 and back.counter_errors == 0 and len(payload) % 576 == 0 and payload
    assert back.elementary == len(back.pts) == len(back.random_access) == -(-len(payload) // media.ACCESS_BYTES)
    assert back.pts == [126000 + 3600 * k for k in range(back.elementary)]


def test_damage_is_seen():
    stored = bytearray(media.mux(media.pad(b"x" * 5000)))
    stored[188 * 5 + 3] ^= 5
    assert media.demux(bytes(stored)).counter_errors
    stored[10] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(stored))


def test_media_digest_equals_brute_force(spark):
    rows = corpus() + [(70, "\U0001f600" * 30_000), (71, "x" * 2_000_000)]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored, feature = brute.transport_stream(padded)
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
    df = spark.createDataFrame(rows, DOCS).withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit(1)).repartition(3)
    assert tuples(media.digest(df), *names) == sorted(want, key=str)
    assert media.digest(df.limit(0)).count() == 0


def test_media_column(docs):
    kept = media.store(docs)
    back = {r.doc_id: r for r in media.read(kept).collect() if r.doc_id is not None}
    long = dict(corpus())[63].encode()
    assert bytes(back[63].payload) == media.pad(long) and back[63].pts == [126000] and back[63].random_access == [0] and back[63].counter_errors == 0
    assert bytes(back[50].payload) == bytes(back[51].payload) == b"\xff" * 576 and kept.count() == len(corpus())


# -- 7 ----------------------------------------------------------------------------------------------------


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in corpus()}
    pieces = packing.pack(docs, length=256, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, own in by_doc.items():
        assert sum(p.length for p in own) == len(ids[i]) * (2 if i == 60 else 1)
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    short = [own for own in by_sequence.values() if sum(p.length for p in own) < 256]
    assert len(short) <= 1
    bare = packing.pack(docs.withColumn("ids", F.lit(1)).withColumn("task", F.lit(2)).withColumn("curve_key", F.lit(0)), length=256, task_ids=500)
    assert bare.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fill = bare.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("k"), F.count(F.lit(1)).alias("m")).collect()
    assert sum(r.n for r in fill) == sum(p.length for p in pieces) and sum(r.n < 256 for r in fill) <= 1 and all(r.n <= 256 and r.k == r.m for r in fill)


@pytest.mark.parametrize("text", ["", "a0b 10 0 The THE the, x. <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b it's IT'S don't.", "é İ ΣΑΣ \x1c\x1d x y z 東京 ½ ⅐ 0０ ,. .", "a b c\x85 'S 's ... ,,, < é x́"])
def test_ids_word_by_word_equal_whole_text(text):
    words = packing.Words(packing.tokenizer_path())
    raw = text.encode()
    for _ in range(2):
        assert words.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_hilbert_is_a_walk():
    side = 1 << 2
    cells = np.array([[a, b, c] for a in range(side) for b in range(side) for c in range(side)])
    key = packing.hilbert(cells, bits=2)
    walk = cells[np.argsort(key)]
    assert sorted(key) == list(range(side**3)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing_of_a_very_long_text(spark):
    text = prose(150_000, 31)
    words = packing.Words(packing.tokenizer_path())
    raw = text.encode()
    ids = np.append(words.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], 2)
    pieces = packing.pack(spark.createDataFrame([(1, text), (2, "short"), (None, None)], DOCS), with_ids=True).collect()
    own = sorted((p for p in pieces if p.doc_id == 1), key=lambda p: p.start)
    assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == ids.tolist() and len(own) >= len(ids) // 4096 and all(p.doc_tokens == len(ids) for p in own)
    assert [p.length for p in pieces if p.doc_id is None] == [1]


def test_shuffle_files_of_written_tables_are_removed(spark):
    from docloom.llm.common import CLEANUP, Scratch

    before = spark.conf.get(CLEANUP)
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert kept.count() == 7 and spark.conf.get(CLEANUP) == before
    with freed():
        inner = Scratch(spark)
        inner.keep(spark.range(3).toDF("x"), "u")
    assert kept.count() == 7 and not os.path.exists(inner.root.removeprefix("file://")) and os.path.exists(scratch.root.removeprefix("file://"))


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# -- 8 ----------------------------------------------------------------------------------------------------


def test_chats(spark):
    r = random.Random(1)
    rows = []
    for c in range(40):
        talk = [("user" if k % 2 == 0 else "assistant", f"t{r.randint(0, 1)}") for k in range(r.randint(1, 5))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(talk)]
    rows += [(90, 0, "user", None), (91, 0, "user", ""), (92, None, None, "x"), (None, 0, "user", "only"), (93, 0, "user", "a<|im_end|>b"), (93, 0, "user", "a<|im_end|>b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = chat.format_chats(df).collect()
    assert {x.conv_id: x.n_copies for x in got} == brute.maximal_chats(rows)
    one = next(x for x in got if x.conv_id == 93)
    assert one.text == "<|im_start|>user\nab<|im_end|>\n" * 2 and one.n_turns == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_and_many_conversations(spark):
    """A conversation of 20,000 turns beside its prefixes, and a first turn that all share."""
    talk = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(20_000)]
    rows = [(1, k, r, x) for k, (r, x) in enumerate(talk)] + [(2, k, r, x) for k, (r, x) in enumerate(talk[:7_000])] + [(3, k, r, x) for k, (r, x) in enumerate(talk[:1])]
    rows += [(10 + c, k, *(talk[0] if k == 0 else ("assistant", f"answer {c} {k}"))) for c in range(300) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("a", "b", "k", "n", "last", "c", "t", "n_copies"):
        df = df.withColumn(name, F.lit("clash"))
    got = {x.conv_id: x for x in chat.format_chats(df).collect()}
    assert set(got) == {1, *range(10, 310)} and got[1].n_turns == 20_000 and all(x.n_copies == 1 for x in got.values())
    assert got[1].text.startswith("<|im_start|>user\nturn 0<|im_end|>\n<|im_start|>assistant\nturn 1<|im_end|>\n") and got[1].text.count("<|im_end|>") == 20_000


def test_turns_in_any_order_of_rows_and_null_turns(spark):
    rows = [(1, None, "user", "a"), (1, 2, "user", "c"), (1, 1, "user", "b"), (2, 5, "user", "a"), (2, 7, "user", "b"), (3, 0, "b", "a"), (3, 0, "a", "b"), (4, 0, None, "a"), (5, 0, "", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {x.conv_id: (x.n_turns, x.n_copies) for x in chat.format_chats(df).collect()}
    assert got == {1: (3, 1), 3: (2, 1), 4: (1, 1), 5: (1, 1)} and {c: 1 for c in got} == brute.maximal_chats(rows)


# -- 9 ----------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">Cookies!</div><div class="ad">Buy</div>
<main><article><h1>Head &amp; line</h1><p>One <b>two</b>&nbsp;&eacute;<br>three<p>Four &lt;5<ul><li>x</li><li>y</li></ul><form><input>Sign up</form><div class="comments"><p>Bad</p></div></article></main>
<aside><p>More</p></aside><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & line\n\nOne two é three\n\nFour <5\n\nx\n\ny"
    assert html.main_text("") == "" and html.main_text("plain < text") == "plain < text" and html.main_text("<p>a<p>b") == "a\n\nb"
    assert html.main_text("<nav>x</nav><footer>y</footer>") == ""
    assert html.main_text("<body><nav>m<article><p>kept</p></article></body>") == "kept"


def test_wrapper_inference():
    pages = [f"<body><div class='top'>t</div><div class='mid'><p>{'w ' * 40}</p>{'<p>' + 'z ' * 30 + '</p>' if k % 2 else ''}</div>{'<div class=x>q</div>' if k == 2 else ''}</body>" for k in range(4)]
    w = None
    for p in pages:
        s = html.skeleton(p)
        w = s if w is None else html.align(w, s)
    text = html.expression(w)
    assert "(<p>#</>)+" in text and "(<div.x>#</>)?" in text and html.main_path(w) == ["body", "div.mid"]
    assert html.main_text(pages[1], html.main_path(w)).count("\n\n") == 1


def test_extract(spark):
    rows = [(1, "http://h.x/a", PAGE), (2, "http://H.x:80/b", None), (3, None, "<p>z"), (4, "no url", ""), (4, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text.startswith("Head") and got[1].n_chars == len(got[1].text) and got[2].text == "" and got[3].text == "z" and html.extract(df).count() == 5
    assert html.extract(df.limit(0)).count() == 0
    hosts = df.select(html.host(F.col("url")).alias("h")).collect()
    assert [r.h for r in hosts] == ["h.x", "h.x", "", "", ""]


def test_articles_are_never_left_out():
    text = "word " * 60
    assert html.main_text(f"<body><div class='social promo'><article><p>{text}</p></article></div><div class=footer>f</div></body>") == text.strip()
    assert html.main_text(f"<body><article class='search-result'><div class='notice'><p>{text}</p></div><div class=share>s</div></article></body>") == text.strip()
    assert html.main_text(f"<form id=page><div class=menu>m</div><article><p>{text}</p></article></form>") == text.strip()


def test_names_leave_out_containers_only_if_they_say_nothing_else():
    page = '<article><p>keep</p><section class="related-work"><p>too</p></section><p class="reply">He said yes.</p><div class="comments-list"><p>no</p></div><div id="share-buttons">no</div></article>'
    assert html.main_text(page) == "keep\n\ntoo\n\nHe said yes."


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div>" * 5000 + "deep text" + "</div>" * 5000, "deep text"),
        ("<article>" + "<div><b>" * 50_000 + "deep", "deep"),
        ("<p>start</p>" + '<a "' * 250_000, None),
        ("<a 'x>' " * 100_000 + "end", None),
        ("<" * 300_000 + "end", None),
        ("<!x" * 200_000 + "end", None),
        ("<div>" * 20_000 + "</b>" * 200_000 + "end", "end"),
        ("<p>a</p><div>b</div>" * 20_000, "\n\n".join(["a", "b"] * 20_000)),
        ("".join(f"<div class=c{i}>t</div>" for i in range(30_000)), "\n\n".join("t" * 30_000)),
        ("<script>" * 1000 + "var x", ""),
        ('<p title="a > b <i>">kept</p><p title=">">too</p><svg/>end', "kept\n\ntoo\n\nend"),
    ],
)
def test_awkward_pages_take_linear_time(page, want):
    import json
    import time

    began = time.process_time()
    got = html.main_text(page)
    wrapper = html.skeleton(page)
    for other in (html.skeleton("<div><p>x</p></div>"), html.skeleton(page)):
        wrapper = html.prune(html.align(wrapper, other))
    assert json.loads(json.dumps(wrapper))[1] == 3 and html.main_path(wrapper) is not None and html.constant_paths(wrapper, []) is not None and html.expression(wrapper)
    assert time.process_time() - began < 10
    assert want is None and got.startswith(("start", "'", "<")) or got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_extract_equals_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted(((r.page_id, brute.article_text(r.html)) for r in pages.collect()), key=str)
    assert tuples(html.extract(pages.withColumn("path", F.lit("clash")).withColumn("drop", F.lit(1)).repartition(5)), "page_id", "text") == want


def test_wrapper_of_a_hot_host_is_merged_from_many_tasks(spark):
    """Without article tags, class words or menus: only the alignment of a host's pages tells text from what is on every page."""
    rows = [(i, "http://hot.x/p", f"<body><div class=k1><div class=q>Everything on this site is served fresh each day to all</div><div class=z>{'<p>' + prose(50, i) + '</p>' if i % 5 else '<dl><dd>' + prose(60, i) + '</dd></dl>'}</div></div></body>") for i in range(120)]
    rows += [(1000 + i, f"http://cold{i}.x/p", f"<body><div class=k1>{prose(20, i)}</div></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df.repartition(11)).collect()}
    assert all(got[i] == prose(50 if i % 5 else 60, i) for i in range(120)) and all(got[1000 + i] == prose(20, i) for i in range(30))
    assert html.wrappers(df.repartition(9)).count() == 31


def test_wrapper_keeps_rare_groups_of_a_varied_host(spark, monkeypatch):
    """300 boxes, each the same on three pages, beside more groups than a task holds: all are left out, in one task or many."""
    monkeypatch.setattr(html, "MOST_GROUPS", 200)
    rows = [(i, "http://varied.x/p", f"<body><div class=k1><p>{prose(30, i)}</p><p>{prose(30, 9000 + i)}</p><div class=box{i // 3}>Section {i // 3} is brought to you by its friends</div></div></body>") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {i: prose(30, i) + "\n\n" + prose(30, 9000 + i) for i in range(900)}
    wrapper = None
    for _, _, page in rows:
        s = html.skeleton(page)
        wrapper = s if wrapper is None else html.prune(html.align(wrapper, s))
    assert html.groups(wrapper) == 1 + 1 + 1 + 1 + 300 and sum(k[1] for k in wrapper[6][0][6][0][6]) == 900 * 2


def test_wrapper_decides_on_pages_with_articles():
    def page(k):
        body = "".join(f"<p>{prose(40, 10 * k + j)}</p>" for j in range(3))
        return f"<body><div class=list><article><p>Latest offers of the house</p></article></div><div class=text>{body}<div class=legal>All of this is the same everywhere</div></div></body>", [prose(40, 10 * k + j) for j in range(3)]

    pages = [page(k) for k in range(4)]
    w = None
    for p, _ in pages:
        s = html.skeleton(p)
        w = s if w is None else html.align(w, s)
    path = html.main_path(w)
    assert path == ["body", "div.text"]
    assert [html.main_text(p, path, html.constant_paths(w, path)).split("\n\n") for p, _ in pages] == [t for _, t in pages]


# -- 10 ---------------------------------------------------------------------------------------------------


def labelled(n=900):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = prose(r.randint(20, 120), i).split()
        bad = i % 7 == 0
        if bad:
            for _ in range(max(1, len(words) // 30)):
                words.insert(r.randrange(len(words)), r.choice(["villain", "Rotten,", "villainous"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if i % 5 else 0, int(bad)))
    return rows, labels


def test_chain_on_held_out_documents(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows + [(2000, None), (2001, ""), (2002, rows[0][1])], DOCS).withColumn("labels", F.lit(1))
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(1, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = [i for i, _, _ in labels if i % 3 == 0]
    hit = [got[i].toxic == int(i % 7 == 0) for i in held]
    assert np.mean(hit) > 0.95 and got[2000].toxic == got[2001].toxic == 0 and got[2002].p_toxic == got[0].p_toxic
    assert len(chain.models[1].earlier) == 1 and len(chain.models[0].earlier) == 0
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_training_sample(spark, monkeypatch):
    rows = [(i, f"common w{i % 4000} only{i}") for i in range(10_050)]
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda held, labels, names: seen.append((held, labels)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels)
    toxicity.train(docs.repartition(7), labels.repartition(3))
    (one, y), (two, z) = seen
    assert len(one.ends) == 10_001 and len(y) == 10_000 and len(one.slots) == one.ends[-1] > 60_000
    assert all((getattr(one, k) == getattr(two, k)).all() for k in ("ends", "slots", "rates")) and (y == z).all()
    # An id of many rows counts once for each different text, and the values are bounded too.
    many = spark.createDataFrame([(7, f"text number {i % 5}") for i in range(300)], DOCS)
    toxicity.train(many, spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"))
    toxicity.train(docs, labels, values=1000)
    assert len(seen[2][0].ends) == 6 and 900 < len(seen[3][0].slots) <= 1000


def test_scores_equal_plain_ones(spark):
    rows, labels = labelled(300)
    rows += [(2000, None), (2001, ""), (2002, "ÉTÉ Villain-rotten x_y 9a é"), (2003, "rotten villain " * 200_000), (2002, rows[5][1])]
    docs = spark.createDataFrame(rows, DOCS)
    chain = toxicity.train(docs.where("doc_id < 2000"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = sorted(((i, *brute.chain(chain, t)) for i, t in rows), key=str)
    got = tuples(toxicity.score(docs, chain), "doc_id", "p_low_quality", "p_toxic")
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1:] for r in got], [r[1:] for r in want], atol=1e-5)


def test_chain_without_labels(spark):
    docs = spark.createDataFrame(labelled(20)[0], DOCS)
    chain = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, chain).where("toxic = 1").count() == 0 and toxicity.score(docs.limit(0), chain).count() == 0


# -- the queries and the pipeline -------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_queries(spark):
    import duckdb

    from docloom.llm import queries

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        got = c.execute(sql)
        cols = [d[0] for d in got.description]
        assert sorted(df.columns) == sorted(cols)
        assert sorted(str([r[k] for k in cols]) for r in df.collect()) == sorted(str(list(r)) for r in got.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(SF + "/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        seen.append(docs := spark.read.parquet(str(tmp_path / str(k))))
    columns = spark.read.parquet(SF + "/documents.parquet").columns
    assert all(d.columns == columns for d in seen[:-1])
    clean = [(r.doc_id, r.text) for r in seen[0].collect()]
    groups = brute.similar(clean)
    assert {r.doc_id for r in seen[1].collect()} == set(groups.values())
    rest = [(r.doc_id, r.text) for r in seen[1].collect()]
    kept = {i: n - gone for i, n, gone, _ in brute.substring(rest)}
    assert {r.doc_id: len(r.text.split()) for r in seen[2].collect()} == kept
    assert seen[4].agg(F.sum("length")).first()[0] > 0


AWKWARD = [(1, None, "s", 1), (1, "", "s", 1), (None, prose(80, 1), None, 2), (None, prose(80, 1), None, 2), (None, prose(90, 2), "t", 2), (4, prose(80, 1) + " x", "s", 3), (5, prose(9000, 3), "t", 4), (5, prose(9000, 3), "t", 4), (6, prose(70, 4) + " " + prose(60, 5), "t", 5), (7, prose(60, 5) + " end", "s", 6), (8, "é", "u", 7)]


def test_pipeline_run_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages; so does an empty table."""
    import corpus_pipeline as p

    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, source string, n_chars int").withColumn("lang", F.lit("en"))
    for name in ("_id", "_print", "spans", "row", "hash", "ids", "key", "print"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    got = p.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in got} >= {5, 6, 8} and sum(r.length for r in got) > 9000
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b/labels.parquet"))
    assert p.run(spark, str(tmp_path / "b")).count() == 0
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path / "a"))
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        out.write.parquet(str(tmp_path / name))
        seen = spark.read.schema(docs.schema).parquet(str(tmp_path / name))
    assert seen.where("doc_id = 8").first().row == "row"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_mixing_and_packing_equal_plain_ones(spark, tmp_path):
    """Delivered words against targets worked out anew, and every delivered document packed whole."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    words = {}
    for r in docs.select("source", "text").collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.encode().split())
    want = brute.targets(words)
    mixed = dict(p.STAGES)["mixing"](spark, docs, SF)
    mixed.write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    got, copies = {}, {}
    for r in mixed.select("doc_id", "source", "text").collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.encode().split())
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) == 2
    assert all(abs(got.get(s, 0) - t) <= max(0.01 * t, 300) for s, t in want.items())
    tok = Tokenizer.from_file(packing.tokenizer_path())
    some = mixed.orderBy("doc_id").limit(300)
    some.write.parquet(str(tmp_path / "some"))
    some = spark.read.parquet(str(tmp_path / "some"))
    ids, rows = {}, some.collect()
    for r in rows:
        ids.setdefault(r.doc_id, []).append([*tok.encode(r.text, add_special_tokens=False).ids, 2])
    pieces = {}
    for x in dict(p.STAGES)["packing"](spark, some, SF).collect():
        pieces.setdefault(x.doc_id, []).append((x.start, x.length, x.ids_crc32, x.doc_tokens))
    for i, texts in ids.items():
        one = texts[0]
        assert sum(n for _, n, _, _ in pieces[i]) == len(one) * len(texts)
        assert all(c == zlib.crc32(np.array(one[a : a + n], "<u4").tobytes()) and total == len(one) for a, n, c, total in pieces[i])
