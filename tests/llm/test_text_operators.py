"""Corpus operators on small tables, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import math
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import boosted_rules, chat_format, components, doc_stats, media, mixing, packing, rff_quality, simhash, substring_index, toxicity


def words(r, n, most=400):
    return " ".join(f"w{int(most * r.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """doc_id, text, lang, source, n_chars: copies, near copies, shared passages, nulls, blanks, a long text, a repeated row."""
    r = random.Random(1)
    passage = words(r, 40)
    rows = []
    for i in range(40):
        text = words(r, r.randint(5, 120))
        if i % 5 == 1:
            text = rows[-1][1]
        if i % 7 == 2:
            text = f"{text}\n{passage} tail{i}\t{words(r, 6)}"
        rows.append((i, text))
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "one"), (44, "One"), (45, "a b c d e f g h i j k l m"), (46, "a b c d e f g h i j k l m"), (47, "   x\x1cy é😀"), (48, words(r, 30_000)), (49, "z" * 50_000)]
    rows.append(rows[3])
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    return docs.withColumns({c: F.lit(1) for c in ("_k", "_b", "fp", "root", "run", "features", "t", "p", "h", "score", "n_words")})


def simhash_of(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(fps):
    """id -> smallest id reachable over fingerprints at most 2 bits apart."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_simhash_groups(docs, corpus):
    fps = {r[0]: simhash_of(r[1]) for r in corpus if r[0] != 48} | {48: simhash_of(corpus[48][1])}
    expected = groups_of(fps)
    got = simhash.near_groups(clashing(docs)).collect()
    assert len(got) == len(corpus)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", expected[i]) for i in fps}


def test_simhash_null_keys_and_nothing(spark, empty):
    df = spark.createDataFrame([(None, "x y z"), (5, "x y z"), (3, "x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()} == {(None, 3), (5, 3), (3, 3)}
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 20, 31, 32, 63])
def test_bit_slices_are_distances(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    values = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(3), base ^ np.uint64(7), base ^ (np.uint64(1) << np.uint64(63))])
    r.shuffle(values)
    runs = np.sort(r.integers(0, 4, len(values)))
    found = set(simhash.sliced_links(values, runs, radius))
    assert found == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if runs[i] == runs[j] and int(values[i] ^ values[j]).bit_count() <= radius}


def test_links_lose_no_component(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 9) for j in range(0, 64, 7)} | {0, 2**64 - 1}
    signed = {f - 2**64 if f >> 63 else f: f for f in fps}
    roots = {x.node: x.root for x in components.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    expected = groups_of({s: f for s, f in signed.items()})
    assert {s: roots.get(s, s) for s in signed} == expected


def test_bitmaps_miss_no_key(spark):
    from spanweave.llm import _support

    keys = spark.range(0, 3000, 3).selectExpr("id", "cast(id as string) as name")
    rows = spark.range(30_000).selectExpr("id", "cast(id as string) as name")
    hit = {r.id for r in _support.with_hits(rows, _support.bitmap(keys, "id", "name"), "id", "name").where("_hit").collect()}
    assert hit >= set(range(0, 3000, 3)) and len(hit) < 1000 + 20
    assert _support.with_hits(rows, _support.bitmap(keys.where("false"), "id"), "id").where("_hit").count() == 0


def test_hot_keys_are_joined_in_parts(spark, monkeypatch):
    from spanweave.llm import _support

    monkeypatch.setattr(_support, "HOT_ROWS", 20)
    many = spark.range(300).selectExpr("id", "if(id % 3 = 0, 7, if(id % 50 = 1, null, id)) as k")
    one = spark.createDataFrame([(7, "a"), (8, "b"), (500, "c")], "k long, v string")
    for how in ("inner", "left", "left_anti"):
        expected = sorted(map(tuple, many.join(one, "k", how).collect()), key=str)
        assert sorted(map(tuple, _support.joined(many, one, "k", how).collect()), key=str) == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def windows_removed(rows):
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][k : k + 13]), i)
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_dedup(docs, corpus, empty):
    expected = windows_removed([r[:2] for r in corpus])
    got = substring_index.deduplicate(clashing(docs)).collect()
    assert len(got) == len(corpus)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *e) for i, e in expected.items()}
    assert sum(e[1] > 0 for e in expected.values()) > 5
    kept = {r.doc_id: r for r in substring_index.strip(docs).collect()}
    for i, text, *_ in corpus:
        n, removed, sha = expected[i]
        if removed and removed == n:
            assert i not in kept
        elif removed:
            assert hashlib.sha256(kept[i].text.encode()).hexdigest() == sha and kept[i].n_chars == len(kept[i].text)
        else:
            assert kept[i].text == text
    assert substring_index.deduplicate(empty).count() == 0 and substring_index.strip(empty).count() == 0


def test_substring_null_ids(spark):
    w = " ".join("abcdefghijklmnop")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_index.deduplicate(spark.createDataFrame([(None, w), (2, w), (1, w)], "doc_id long, text string")).collect()}
    assert got == {None: (16, 0), 1: (16, 0), 2: (16, 16)}


def test_substring_index_over_batches(spark, docs, corpus, tmp_path):
    """Batches of rising ids against an index, compacted on the way, give what one batch gives."""
    index = substring_index.SubstringIndex(spark, str(tmp_path / "index"))
    found = {}
    for n, (a, b) in enumerate(((0, 15), (15, 30), (30, 60))):
        batch = docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))
        found |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.deduplicate(batch).collect()}
        index.add(batch, name=f"run{n}")
        if n == 1:
            index.compact(name="merged")
    assert found == windows_removed([r[:2] for r in corpus])
    assert index.runs() is not None


def test_substring_dedup_over_levels(docs, corpus, monkeypatch):
    """More runs than one merge takes: what is told comes down through the levels."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(substring_index, "RUN_BYTES", size // 300)
    parts, runs = substring_index._sizes(docs, "text")
    assert substring_index._levels(runs) == 1
    got = substring_index.deduplicate(docs).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *e) for i, e in windows_removed([r[:2] for r in corpus]).items()}


def exchanged(units, monkeypatch, fan):
    """substring_index's merges on the driver: told (unit -> h) and the number of blobs of all levels."""
    import pyarrow as pa

    X = substring_index
    monkeypatch.setattr(X, "FAN_BITS", fan)
    table = lambda rows: X._table(rows, X._UP)

    def groups(t, *keys):
        found = {}
        for row in t.to_pylist():
            found.setdefault(tuple(k(row) for k in keys), []).append(row)
        return {k: pa.Table.from_pylist(v, schema=t.schema) for k, v in found.items()}

    part, unit, owner = lambda r: r["part"], lambda r: r["unit"], lambda r: r["unit"] >> fan
    up, steps = pa.concat_tables([table(X._cut(u, 0, *x)) for u, x in enumerate(units)]), []
    blobs = up.num_rows
    for level in range(X._levels(len(units))):
        steps.append(up)
        up = pa.concat_tables([X._next_level(g, level) for g in groups(up, part, owner).values()])
        blobs += up.num_rows
    down = pa.concat_tables([X._last_merge(g) for g in groups(up, part).values()])
    for step in reversed(steps):
        told = groups(down, lambda r: r["part"] >> fan, unit)
        down = pa.concat_tables([X._pass_down(g, told.get(k, down.slice(0, 0))) for k, g in groups(step, part, owner).items()])
    return {k[0]: X._told(g) for k, g in groups(down, unit).items()}, blobs


@pytest.mark.parametrize("windows", [False, True])
def test_merges_tell_each_run_what_it_needs(monkeypatch, windows):
    r = np.random.default_rng(4)
    pool = r.integers(0, 2**64, 3000, dtype=np.uint64)
    units, has = [], {}
    for u in range(100):  # 4 a merge: 100 runs make four levels
        h = np.unique(r.choice(pool, 120))
        c = np.where(h % np.uint64(7) == 0, r.integers(0, 2, len(h)), 0).astype(np.uint64)  # fingerprints with two checks
        d = r.integers(0, 50, len(h)).astype(np.uint64)
        units.append((h, *X_sorted(h, c, d)) if windows else (h,))
        for x in zip(h.tolist(), c.tolist() if windows else [0] * len(h), d.tolist()):
            has.setdefault(x[:2], []).append((x[2], u))
    told, _ = exchanged(units, monkeypatch, 2)
    for u, x in enumerate(units):
        h, c = x[0], x[1] if windows else np.zeros(len(x[0]), np.uint64)
        need = [min(has[k])[0] < d if windows else len(has[k]) > 1 for k, d in zip(zip(h.tolist(), c.tolist()), x[2].tolist() if windows else h.tolist())]
        found = substring_index._among(h, c if windows else None, *told[u]) if u in told else np.zeros(len(h), bool)
        assert found.tolist() == need


def X_sorted(h, c, d):
    return c, d


def test_blobs_grow_with_the_runs(monkeypatch):
    """Eight times the runs give some eight times the blobs, whatever the number of levels."""
    r = np.random.default_rng(4)
    count = lambda n: exchanged([(np.unique(r.integers(0, 2**64, 500, dtype=np.uint64)),) for _ in range(n)], monkeypatch, 3)[1]
    few, many = count(64), count(512)
    assert many < 8 * few * 1.6


def test_packing(docs, corpus, empty):
    encoder = packing.encoder(packing.default_tokenizer()).tokenizer
    expected = {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in corpus}
    got = packing.pack(clashing(docs), with_ids=True).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and 2**r.bucket == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert len({r.sequence_id for r in got}) == len(got)
    for i, ids in expected.items():
        own = sorted(pieces[i], key=lambda r: (r.start, r.sequence_id))
        joined = [x for r in own for x in r.ids]
        assert joined == ids if i != 3 else sorted(joined) == sorted(ids * 2)  # id 3 is there twice
        assert {r.doc_tokens for r in own} == {len(ids)}
    assert packing.pack(empty).count() == 0
    of, size = packing.cuts(np.array([9000, 0, 4096, 5]))
    assert size.tolist() == [4096, 4096, 512, 256, 32, 8, 4096, 4, 1] and of.tolist() == [0] * 6 + [2] + [3] * 2


def encoded(e, texts):
    flat, count = e.encode([t.encode() for t in texts])
    at = np.cumsum(np.append(0, count))
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_letter_words_join_as_the_library_does():
    e = packing.WordEncoder(packing.default_tokenizer())
    texts = ["thou The, é. ÉÈ naïve straße ﬁ İ ΣΑΣ × ÷. don't I'LL 've 12,345.6 ... a.b. x., <|endoftext|>. é. éé,", "", "  ", "日本語 🙂🙂 a\x1cb",
             "a<|endoftext|>B <|ENDOFTEXT|> <B>Bold</B>, THE end.<p> x<y,", "w" * 60 + ". " + "ab" * 40]
    r = random.Random(2)
    texts += [" ".join("".join(r.choice("abcdeimnorstuéüßñA.,<|'1") for _ in range(r.randint(1, 30))) for _ in range(50)) for _ in range(40)]
    expected = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for part in (texts, texts[::-1], texts):  # new words, then known ones
        assert encoded(e, part) == (expected if part is texts else expected[::-1])


def test_known_words_are_emptied_when_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 7)
    e = packing.WordEncoder(packing.default_tokenizer())
    texts = [f"alpha{chr(97 + i)} beta gamma{chr(98 + i)} 4{i}" for i in range(12)]
    assert [encoded(e, [t])[0] for t in texts] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_media_round_trip(docs, corpus, empty):
    got = {r.doc_id: r for r in media.read_digests(media.store_texts(clashing(docs))).collect()}
    for i, t, *_ in corpus:
        b = (t or "").encode()
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(b), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-64:])
        assert got[i].media_bytes == len(media.to_wav(payload)) and got[i].media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
    assert media.read_digests(media.store_texts(empty)).count() == 0


def test_reading_back_corrects_and_carves(spark):
    """A WAV cell that was declared as something else, with a picture among its samples."""
    host = media.to_wav(b"x" * 64 + png() + bytes(64))
    cells = spark.createDataFrame([(1, 9, host, "image/png", 0), (2, 9, media.to_wav(bytes(64)), None, 0)], "doc_id long, n_bytes long, media binary, declared string, detected int")
    got = {r.doc_id: r.feature for r in media.read_digests(cells).collect()}
    assert got[1].endswith(f"declared=corrected;embedded=1;carved={zlib.crc32(png())}") and got[2].endswith("declared=corrected;embedded=0;carved=0")


def png():
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import gzip

    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    assert media.sniff(png()) == [(0, len(png()), "image/png")]
    assert media.sniff(gif) == [(0, len(gif), "image/gif")]
    assert media.sniff(b"BM" * 50) == [] and media.sniff(b"RIFF1234WAVEfmt ") == [] and media.sniff(png()[:-1]) == []
    host = media.to_wav(b"x" * 10 + png() + b"GIF89a broken" + gzip.compress(b"data") + b"\0\0")
    spans = media.sniff(host)
    assert [s[2] for s in spans] == ["audio/wav", "image/png", "application/gzip"] and spans[0][:2] == (0, len(host))
    cells = spark.createDataFrame([(1, host, "image/png"), (2, png(), "image/png"), (3, None, "a/b"), (4, b"text", None)], "id long, media binary, declared string").withColumn("detected", F.lit("clash"))
    got = {r.id: r for r in media.correct_types(cells).collect()}
    assert (got[1].detected, got[1].type_ok, len(got[1].embedded)) == ("audio/wav", False, 2)
    assert media.carve(host, [e.asDict() for e in got[1].embedded])[0] == png()
    assert got[2].type_ok and got[3].detected is None and got[3].type_ok is None and got[4].detected == media.UNKNOWN and got[4].type_ok


def brute_statistics(text):
    w = (text or "").encode().split()
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_statistics(docs, corpus):
    more = ["x y\nx y\n \nx y", "# * $ |a| <b>", " ".join("abcdefghi" * 9), "é è ê\n\né è ê", "a b c d e f g h a b c d e f g h"]
    for t in [r[1] for r in corpus] + more:
        assert doc_stats.statistics((t or "").encode())[0] == brute_statistics(t)


def labelled(n=400, seed=5):
    """Good prose, symbol junk (quality 0) and insults (toxic 1), with labels for all."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        t = words(r, r.randint(30, 90))
        q, x = 1, 0
        if i % 5 == 0:
            t, q = " ".join(w + "$$$" for w in t.split()), 0
        if i % 4 == 1:
            w = t.split()
            at = r.randrange(len(w))
            t, x = " ".join(w[:at] + [r.choice(["dolt", "cretin", "cretinous"]) for _ in range(4)] + w[at:]), 1
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, q, x))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def judged(spark):
    rows, labels = labelled()
    return spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "en", "s", 0)], SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], LABELS), {i: (q, x) for i, q, x in labels}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("run, at", [(rff_quality.classify, 0), (toxicity.detect, 1)])
def test_classifiers_hold_out(judged, run, at, spark, empty):
    docs, labels, truth = judged
    got = {r.doc_id: r for r in run(docs.withColumn("features", F.lit(1)), labels).collect()}
    assert len(got) == docs.count() and all(got[i].held_out == held(i) for i in truth)
    assert all(0 <= r.score <= 1 for r in got.values())
    out = [i for i in truth if held(i)]
    assert sum(got[i].predicted == truth[i][at] for i in out) / len(out) > 0.95
    assert got[900].score == got[901].score
    none = run(docs, spark.createDataFrame([], LABELS)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert run(empty, labels).count() == 0
    flipped = labels.withColumns({c: F.when((F.crc32(F.col("doc_id").cast("string")) % 4) == 2, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert {r.doc_id: round(r.score, 9) for r in run(docs, flipped).collect()} == {i: round(r.score, 9) for i, r in got.items()}


def test_quality_filter(judged):
    docs, labels, truth = judged
    kept = rff_quality.keep(docs.withColumn("_b", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "_b"]
    ids = {r.doc_id for r in kept.collect()}
    assert all((i in ids) == bool(q) for i, (q, _) in truth.items())


def test_rules(judged, spark):
    docs, labels, truth = judged
    got = {r.doc_id: r for r in boosted_rules.judge(docs, labels).collect()}
    for r in docs.collect():
        assert (got[r.doc_id].n_words, got[r.doc_id].word_chars, got[r.doc_id].n_symbols, got[r.doc_id].n_dup_lines, got[r.doc_id].n_repeat_words) == brute_statistics(r.text)
        g = got[r.doc_id]
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words) and (not g.base_failed or not g.kept)
    assert all(got[i].kept == bool(q) for i, (q, _) in truth.items())
    assert {r.kept for r in boosted_rules.judge(docs, spark.createDataFrame([], LABELS)).where("not base_failed").collect()} == {True}


def test_trees_are_monotone_and_flat():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = (x[:, 0] + 0.3 * r.random(600) < 0.6).astype(float)
    forest = boosted_rules.grow(x, y, np.array([-1, 0, 0]), trees=20)
    probe = np.repeat(r.random((50, 3)), 21, 0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 21), 50)
    steps = np.diff(forest.score(probe).reshape(50, 21), axis=1)
    assert (steps <= 1e-12).all() and ((forest.score(x) > 0.5) == y).mean() > 0.9

    def walk(row):
        total = forest.prior
        for k in forest.roots:
            while forest.feature[k] >= 0:
                k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
            total += forest.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(row) for row in x[:50]], forest.score(x[:50]))


def test_segments_are_maximal():
    r = random.Random(4)

    def brute(s, a, b):
        """The best segment, then left and right of it, as the definition goes."""
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        i, j = best[3], best[4]
        return [*brute(s, a, i), (i, j), *brute(s, j, b)]

    for _ in range(60):
        s = [r.choice([-3, -1, 2, 5, -2, 1]) + r.random() / 100 for _ in range(14)]
        assert [x[:2] for x in toxicity.segments(np.array(s))] == brute(s, 0, len(s))


def brute_log_odds(counts, word):
    """Of a word whose beginnings are not counted, straight from the definition."""
    n0, n1 = (sum(c[i] for u, c in counts.items() if not u.endswith(b"*")) for i in (0, 1))
    share = n1 / (n0 + n1)
    y0, y1 = counts[word][0] + max(10 * (1 - share), 0.5), counts[word][1] + max(10 * share, 0.5)
    return math.log(y1 / y0) - math.log(n1 / n0)


def test_log_odds():
    calm = {b"calm%d" % i: (60 + i, 9) for i in range(50)}
    for k in (100, 1000):
        counts = calm | {b"vile": (0, k), b"kind": (40 * k, 1)}
        table = toxicity._log_odds(counts)
        assert table[b"vile"] == pytest.approx(brute_log_odds(counts, b"vile")) and table[b"kind"] == pytest.approx(min(brute_log_odds(counts, b"kind"), toxicity.COST))


def test_words_of_toxic_documents_only_score_more_the_more_there_are():
    last = 0.0
    for k in (10, 100, 1000):
        counts = {b"calm%d" % i: (k * 5, k // 2) for i in range(50)} | {u: (0, k) for u in toxicity.units(b"disgusting")}
        score = toxicity._Scores(toxicity._log_odds(counts))[b"disgusting"]
        assert score >= last and score > 2
        last = score


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(0)
    x, gamma, size = r.normal(size=(40, 16)) * 0.5, 1 / 64, 4000
    w, b = r.normal(0, np.sqrt(2 * gamma), (16, size)), r.uniform(0, 2 * np.pi, size)
    z = rff_quality._lift(x, np.zeros(16), np.ones(16), w, b)[:, :-1]
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 0.08


def test_normal_equations_are_summed_over_partitions(spark):
    r = np.random.default_rng(1)
    n = len(doc_stats.FEATURES)
    x, y = r.normal(size=(300, n)), r.integers(0, 2, 300).astype(float)
    lift = (x.mean(0), x.std(0), r.normal(size=(n, 20)), r.uniform(0, 6, 20))
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "features array<double>, y double").repartition(5)
    gram, right = rff_quality._sums(rows, lift)
    z = rff_quality._lift(x, *lift)
    assert np.allclose(gram, z.T @ z) and np.allclose(right, z.T @ y)
    assert np.allclose(np.linalg.solve(gram + 0.1 * np.eye(21), right), np.linalg.lstsq(np.vstack([z, np.sqrt(0.1) * np.eye(21)]), np.append(y, np.zeros(21)), rcond=None)[0])


def test_isotonic_is_the_least_squares_fit():
    """Pooled blocks against the min-max formula; each level is shrunk by one pseudo-row of the mean."""
    r = np.random.default_rng(2)
    x, y = np.arange(60.0), (r.random(60) < np.linspace(0.1, 0.9, 60)).astype(float)
    mean = lambda i, j: y[i : j + 1].mean()
    fit = np.array([max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)])
    size = np.array([(fit == v).sum() for v in fit])
    knots, levels = rff_quality.isotonic(x, y)
    assert np.allclose(np.interp(x, knots, levels), (fit * size + y.mean()) / (size + 1))


def test_isotonic_levels_rise():
    x = np.array([3.0, 1, 2, 2, 5, 4])
    knots, levels = rff_quality.isotonic(x, np.array([1.0, 0, 1, 0, 0, 1]))
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all()


def mixed(spark):
    r = random.Random(9)
    alphabets = {"en": "aeinst", "de": "üchukz", "fr": "éàqubl"}
    rows = []
    for i in range(300):
        lang = "en" if i % 10 < 7 else "de" if i % 10 < 9 else "fr"
        rows.append((i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(5)) for _ in range(r.randint(5, 60))), lang, "s", 0))
    rows += [(300, None, "en", "s", 0), (301, "", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 1, 0) for i in range(302) if i % 3], LABELS)


def test_mixing_meets_targets(spark, empty):
    docs, labels = mixed(spark)
    targets = {"en": 0.4, "de": 0.3, "fr": 0.3}
    got = docs.select("doc_id", "lang").join(mixing.mix_rates(docs, labels, targets), "doc_id").collect()
    assert len(got) == 302 and all(r.rate >= 0 and r.n_copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert all(r.domain == r.lang for r in got if r.doc_id < 300)
    total = sum(r.rate * r.n_tokens for r in got)
    for lang, share in targets.items():
        assert abs(sum(r.rate * r.n_tokens for r in got if r.domain == lang) / total - share) < 0.01
    assert abs(total / sum(r.n_tokens for r in got) - 1) < 1e-3
    again = mixing.resample(docs.withColumn("domain", F.lit("clash")), labels, targets)
    assert again.columns == [*docs.columns, "domain"] and {r.doc_id for r in again.collect()} == set(range(302))
    assert mixing.mix_rates(empty, labels, targets).count() == 0
    assert {r.rate for r in mixing.mix_rates(docs, spark.createDataFrame([], LABELS), targets).collect()} == {1.0}


def least_squares(t, p, goal, low, high, start):
    """Brute force: projected gradient on every document's rate by itself, to the optimum of the squared misses."""
    a = p * t[:, None]
    step, r = 1 / np.linalg.norm(a, 2) ** 2, np.full(len(t), start)
    for _ in range(20_000):
        r = np.clip(r - step * (a @ (r @ a - goal)), low, high)
    return ((r @ a - goal) ** 2).sum()


@pytest.mark.parametrize("high", [16.0, 2.0, 1.2])
def test_mixing_rates_are_the_least_squares(spark, high):
    """With reachable targets and with targets that the bound on copies keeps out of reach."""
    docs, labels = mixed(spark)
    targets = {"en": 0.2, "de": 0.2, "fr": 0.6}
    model = mixing.fit_domains(mixing.labelled_documents(docs, labels))
    members = mixing.memberships(docs, model).cache()
    rows = members.collect()
    t, p = np.array([r.t for r in rows], float), np.array([r.p for r in rows])
    encode = packing.encoder(packing.default_tokenizer()).tokenizer.encode
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r._key: r.t for r in rows} == {i: len(encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    goal = np.array([targets[d] for d in model.domains]) * t.sum()
    best = least_squares(t, p, goal, 0.0, high, 1.0)
    if high < 16:
        with pytest.warns(UserWarning, match="miss the target"):
            mix = mixing.fit(members, model, targets, high=high)
    else:
        mix = mixing.fit(members, model, targets, high=high)
        assert mix.missed < 1e-6
    rates = mix.rates(p)
    assert rates.min() >= 0 and rates.max() <= high and np.allclose((rates * t) @ p, mix.expected)
    assert ((np.array(mix.expected) - goal) ** 2).sum() <= best * 1.01 + (1e-5 * goal.sum()) ** 2


def test_copies_are_bounded_and_rows_kept(spark):
    r = random.Random(1)
    en, de = (lambda: " ".join("".join(r.choice(x) for _ in range(5)) for _ in range(20)) for x in ("aeinst", "üchukz"))
    rows = [(i, en(), "en", "s", 0) for i in range(200)] + [(200, de(), "de", "s", 0), (None, en(), "en", None, None), (7, en(), "en", "s", 0), (7, en(), "en", "s", 0)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 1, 0) for i in range(201)], LABELS)
    docs = docs.withColumn("_rate", F.lit("clash")).withColumn("domain", F.lit(1))
    with pytest.warns(UserWarning, match="miss the target"):
        out = mixing.resample(docs, labels, {"en": 0.2, "de": 0.8}).collect()
    times = {i: sum(1 for x in out if x.doc_id == i) for i in (*range(201), None)}
    assert times[200] == 16 and all(1 <= times[i] <= 16 for i in times if i != 7) and times[7] >= 3


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chats_read_back(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>x\n<|sep|>", "<~|end|>\n<~~|sep|>", None, "", "\n", "é😀", "<", "|turn|>", "[[INST]", "<~s>", "a\\b$1"]
    rows = [(1, i, ["user", "user", "assistant", "assistant", None, "a\nb"][i % 6], t) for i, t in enumerate(hard)]
    rows += [(2, 0, "assistant", "only"), (2, 0, "assistant", "only"), (None, 1, "user", "x"), (3, None, "user", "first"), (3, 1, "assistant", "then")]
    formatted = chat_format.format_chats(chats(spark, rows).withColumn("_t", F.lit(1)))
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    expected = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == expected
    assert {c: r.loss_text for c, r in got.items()} == {c: "".join(x for role, x in t if role == "assistant") for c, t in expected.items()}
    one = formatted.where("conv_id = 1").first().formatted
    assert one.count("<|turn|>") == sum(a != b for a, b in zip([None, *[x[0] for x in expected[1]]], [x[0] for x in expected[1]]))
    assert chat_format.format_chats(chats(spark, [])).count() == 0
    sums = {r.conv_id: r for r in chat_format.digests(chat_format.read_back(formatted)).collect()}
    assert sums[2].n_turns == 2 and sums[2].loss_chars == 8 and sums[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in expected[1]).encode()).hexdigest()


def test_long_conversations(spark):
    """Thousands of turns: spans are gathered in stretches, and still cover just the texts."""
    turns = [(1, i, "assistant" if i % 3 else "user", f"t{i}" * (i % 5)) for i in range(3000)] + [(2, 0, "user", "x")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = {r.conv_id: r for r in chat_format.format_chats(rows).collect()}
    cut = [made[1].formatted[s.start : s.start + s.length] for s in made[1].loss_spans]
    assert cut == [t for _, _, role, t in turns[:3000] if role == "assistant"] and made[2].loss_spans == []


def test_hostile_cells_cost_their_length():
    import time
    import zipfile
    from io import BytesIO

    def seconds(n):
        began = time.perf_counter()
        for magic in (b"%PDF-", b"PK\x03\x04", b"PK\x05\x06" + bytes(18), b"\x1f\x8b\x08\x00", b"RIFF\xff\xff\x00\x00WAVE", b"\x89PNG\r\n\x1a\n\x00\x00\xff\xffIHDR", b"BM"):
            media.sniff(magic * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(32_000) < 40 * max(seconds(2_000), 0.02)
    file = BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        for i in range(5):
            z.writestr(f"{i}.txt", "text" * i)
    data = file.getvalue()
    assert media.sniff(data) == [(0, len(data), "application/zip")] and media.sniff(b"xx" + data + b"yy") == [(2, len(data), "application/zip")]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    json.dumps(entry.oracle_sql())


def pdf(revisions):
    out = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    for _ in range(revisions):
        table = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF\n" % table
    return out[:-1]


def test_pdf_revisions_are_whole():
    two, one = pdf(2), pdf(1)
    assert media.sniff(two) == [(0, len(two), "application/pdf")]
    assert media.sniff(b"some text " + two + b" between " + one + b" tail") == [(10, len(two), "application/pdf"), (19 + len(two), len(one), "application/pdf")]
    assert media.sniff(b"%PDF-1.4 startxref 9999 %%EOF") == []
    first = b"%PDF-1.4\n1 0 obj\n<</Linearized 1>>\nendobj\nstartxref\n0\n%%EOF\n"
    linear = first + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(first)
    assert media.sniff(linear) == [(0, len(linear), "application/pdf")]
