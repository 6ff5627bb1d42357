"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tarnfield.llm import graph, kd_shards, language, licences, media, mixing, pivots, queries, selection, shingle_join, superkmers, toxicity, wfst
from tarnfield.plans.workspace import Workspace

WORDS = [f"w{i}" for i in range(90)]
LONG = " ".join(f"x{i % 977}y{i}" for i in range(6000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a b"), (None, "a b"), (8, " ".join(WORDS)), (9, " ".join([*WORDS, "x"])),
    (10, " ".join([*WORDS[:40], "q", *WORDS[41:]])), (10, " ".join(WORDS)), (None, None), (11, "a " * 300), (12, LONG), (13, "é ü \u2581 ☃ " * 20), (14, "lead in " + " ".join(WORDS[5:55]) + " tail"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i and i % 3 == 0 else f"s{(i or 0) % 4}", "en") for i, t in ODD], "doc_id long, text string, source string, lang string")


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- shared parts ---


def test_crossings_equal_sorted_running_sums(spark):
    rng = np.random.default_rng(1)
    data = [(int(n), int(k), int(w)) for n, k, w in zip(rng.integers(0, 3, 500), rng.integers(0, 2**40, 500) // 2**33 * 2**33, rng.integers(1, 50, 500), strict=True)]
    rows = spark.createDataFrame(data, "n int, k long, w long")
    targets = {0: 1000, 1: 1, 2: 10**9}
    got = selection.crossings(rows, F.col("n"), F.col("k"), F.col("w"), targets, bins=7)
    for n, target in targets.items():
        sums = collections.Counter()
        for m, k, w in data:
            if m == n:
                sums[k] += w
        run = 0
        for k in sorted(sums):
            if run + sums[k] >= target or k == max(sums):
                assert (got[n].key, got[n].below, got[n].at) == (k, run, sums[k])
                break
            run += sums[k]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- 1: media ---


def test_media_round_trip(odd):
    got = keyed(tuple(r)[:8] for r in media.text_media(odd).collect())
    want = []
    for i, t in ODD:
        data = (t or "").encode()
        rows = max(1, -(-len(data) // 576))
        payload = data + b"\xff" * (rows * 576 - len(data))
        png = media.to_png(payload)
        assert media.from_png(png) == payload and media.png_header(png[:33]) == (576, rows, 8)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), media.sample_features(payload)))
    assert got == keyed(want)
    assert media.text_media(odd.limit(0)).count() == 0


def test_media_shards_are_tar_files(spark, odd, tmp_path):
    import tarfile

    root = f"file://{tmp_path}"
    rows = odd.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"), F.lit(7).alias("shard")).coalesce(1)
    index = Workspace(spark, "test").save("index", media.pack_media(rows, "payload", root, shard_bytes=4096))
    found = {}
    for p in tmp_path.glob("*.tar"):
        with tarfile.open(p) as tar:
            for m in tar:
                found[p.name, m.offset_data] = hashlib.sha256(tar.extractfile(m).read()).hexdigest()
    got = {(r["shard"], r["offset"]): r["media_sha256"] for r in index.collect()}
    assert got == found and len({s for s, _ in found}) > 1 and len(set(found.values())) < len(ODD)


def plain_features(samples):
    """Mean, deviation, entropy and shares of 8 ranges, value by value."""
    import math

    n = len(samples)
    mean = math.fsum(samples) / n
    dev = math.sqrt(math.fsum((x - mean) ** 2 for x in samples) / n)
    shares = [c / n for c in collections.Counter(samples).values()]
    bands = collections.Counter(x // 32 for x in samples)
    return mean, dev, -math.fsum(p * math.log2(p) for p in shares), "-".join(str(int(round(1000 * bands[i] / n))) for i in range(8))


def test_media_places_and_samples_by_another_reader(spark, odd):
    """Rows name a place in a tar shard; what lies there decodes, chunk by chunk, to the text."""
    import struct
    from pathlib import Path

    from tarnfield.plans.workspace import shared_dir

    rows = odd.unionByName(odd).repartition(5)
    got = media.text_media(rows).collect()
    texts = {hashlib.sha256(p).hexdigest(): t for t, p in ((t, (t or "").encode() + b"\xff" * (-len((t or "").encode()) % 576 or 576 * (not t))) for _, t in ODD)}
    folder = Path(shared_dir(spark).removeprefix("file://"))
    place = {}
    for r in got:
        (shard,) = folder.glob(f"tarnfield-media-*/shards/{r['shard']}")
        data = shard.read_bytes()[r["offset"] : r["offset"] + r["media_bytes"]]
        at, kinds, packed = 8, [], b""
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
            kinds.append(kind)
            packed += body if kind == b"IDAT" else b""
            width, height = struct.unpack(">II", body[:8]) if kind == b"IHDR" else (width, height)
            at += 12 + n
        lines = zlib.decompress(packed)
        assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and (width, height) == (r["width"], r["height"]) and len(lines) == height * (width + 1)
        assert not any(lines[i * (width + 1)] for i in range(height))  # no filter
        samples = b"".join(lines[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))
        assert hashlib.sha256(samples).hexdigest() == r["payload_sha256"] and r["payload_sha256"] in texts
        mean, dev, entropy, bands = plain_features(samples)
        told = dict(x.split("=") for x in r["feature"].split(";"))
        assert float(told["mean"]) == pytest.approx(mean, abs=1e-3) and float(told["dev"]) == pytest.approx(dev, abs=1e-3) and float(told["entropy"]) == pytest.approx(entropy, abs=1e-3) and told["bands"] == bands
        assert place.setdefault(r["media_sha256"], (r["shard"], r["offset"])) == (r["shard"], r["offset"])  # one place a digest


# --- 2: sharding ---


def test_shards(spark, odd):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 30)).otherwise(F.concat(F.repeat(F.lit("ab é\n"), (F.col("id") % 97).cast("int")), F.col("id").cast("string"))).alias("text"))
    out = kd_shards.text_shards(many, 7).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert sorted(size.index) == list(range(7)) and size.max() - size.min() < 0.05 * size.mean()
    assert (out.groupby("shard").slot.max() + 1 == out.groupby("shard").slot.nunique()).all() and (out.groupby("shard").slot.count() == out.groupby("shard").slot.nunique()).all()
    spread = out.groupby("text_crc32").shard.nunique()
    assert spread.nlargest(2).tolist()[1] == 1  # only the hot text is in several shards
    few = kd_shards.text_shards(odd).toPandas()
    assert len(few) == len(ODD) and set(few.shard) <= set(range(24)) and few.law.eq("bytes").all()
    assert kd_shards.text_shards(odd.limit(0)).count() == 0


def plain_kd(rows, shards, heavy):
    """Shard of each row, by recursion over sorted lists; rows: (positions, group, tie, weight)."""
    out = {}

    def crossing(keyed, target):
        sums = collections.Counter()
        for k, w in keyed:
            sums[k] += w
        run = 0
        for k in sorted(sums):
            if run + sums[k] >= target or k == max(sums):
                return k, run, sums[k]
            run += sums[k]

    def grow(held, first, n):
        if n == 1 or not held:
            out.update({i: first for i in held})
            return
        spans = [max(rows[i][0][d] for i in held) - min(rows[i][0][d] for i in held) for d in range(len(rows[0][0]))]
        d = spans.index(max(spans))
        key = {i: (rows[i][0][d] << 32) | (rows[i][1] & 0xFFFFFFFF) for i in held}
        target = round(sum(rows[i][3] for i in held) * (n // 2) / n)
        cut, below, at = crossing([(key[i], rows[i][3]) for i in held], target)
        rest, short = 0, target - below
        if at > heavy:
            tie, under, on = crossing([(rows[i][2], rows[i][3]) for i in held if key[i] == cut], short)
            rest = tie + (short - under > on / 2)
        else:
            cut += short > at / 2
        right = {i for i in held if key[i] > cut or (key[i] == cut and rows[i][2] >= rest)}
        grow([i for i in held if i not in right], first, n // 2)
        grow([i for i in held if i in right], first + n // 2, n - n // 2)

    grow(list(range(len(rows))), 0, shards)
    return out


def test_shards_equal_a_plain_tree(spark):
    import math

    rng = np.random.default_rng(23)
    given = []
    for i in range(500):
        g = int(rng.integers(0, 120)) if i % 4 else 999  # a hot group, and ties
        at = (float(g % 17) * 3, float(g % 5), None if g % 11 == 0 else float(g * g % 101))
        given.append((i, *at, g * 0x9E3779B97F4A7C15 % 2**63, int(rng.integers(0, 2**62)), int(rng.integers(1, 400)), "x"))
    given += [given[7], given[8]]  # repeated rows
    frame = spark.createDataFrame(given, "i long, a double, b double, c double, g long, t long, w long, shard string")
    got = kd_shards.kd_shards(frame, {n: F.col(n) for n in "abc"}, F.col("w"), F.col("g"), F.col("t"), 7).collect()
    places = []
    for d in (1, 2, 3):
        known = [r[d] for r in given if r[d] is not None]
        lo, hi = min(known), max(known)
        places.append([0 if r[d] is None else math.floor((r[d] - lo) / (hi - lo) * kd_shards.STEPS + 0.5) for r in given])
    rows = [(tuple(p[j] for p in places), r[4], r[5], r[6]) for j, r in enumerate(given)]
    want = plain_kd(rows, 7, 0.05 * sum(r[6] for r in given) / 7)
    assert sorted((r["i"], r["shard"]) for r in got) == sorted((given[j][0], s) for j, s in want.items())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


# --- 3: toxicity ---


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    net = toxicity.Network.fresh({})
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.standard_normal((5, 6, toxicity.WORD_DIM + toxicity.CHAR_DIM)) * 0.5
    mask = (np.arange(6) < np.array([6, 3, 1, 5, 6])[:, None]).astype(float)
    y = np.array([1.0, 0, 1, 0, 1])
    grads, d_x, _ = net.gradient(x, mask, y)
    for name in ("xf", "ub", "cf", "attend", "focus", "out"):
        at = tuple(rng.integers(0, n) for n in net.w[name].shape)
        keep, losses = net.w[name][at], []
        for e in (1e-2, -1e-2):  # states are single precision
            net.w[name][at] = keep + e
            losses.append(net.gradient(x, mask, y)[2])
        net.w[name][at] = keep
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=1e-5)


def test_windows_start_at_every_word():
    for n in (0, 1, 31, 32, 33, 94, 95, 96, 97, 200):
        first, size, windows = toxicity.passes(n)
        starts = [f + k for f, w in zip(first, windows, strict=True) for k in range(w)]
        assert starts == list(range(max(1, n - toxicity.WINDOW + 1)))
        assert all(f + w - 1 + min(n, toxicity.WINDOW) <= f + s <= n for f, s, w in zip(first, size, windows, strict=True))


def plain_windows(net, words):
    """Logits of the windows of one pass, word by word, from the weights alone."""
    def read(side, order):
        state, out = np.zeros(toxicity.HIDDEN), {}
        for at in order:
            word = net.w["word"][net.vocabulary.get(words[at], 0)]
            chars = toxicity.char_sums(net.w["char"], *toxicity.char_runs([words[at]]))[0]
            x = np.concatenate([word, chars]) @ net.w[f"x{side}"] + net.w[f"c{side}"]
            rec = state @ net.w[f"u{side}"]
            z, r = (1 / (1 + np.exp(-(x[k : k + 12] + rec[k : k + 12]))) for k in (0, 12))
            state = state + z * (np.tanh(x[24:] + r * rec[24:]) - state)
            out[at] = state
        return out

    ahead, back = read("f", range(len(words))), read("b", range(len(words) - 1, -1, -1))
    states = [np.concatenate([ahead[i], back[i]]) for i in range(len(words))]
    out = []
    for s in range(max(1, len(words) - toxicity.WINDOW + 1)):
        inside = states[s : s + toxicity.WINDOW]
        weight = [np.exp(np.tanh(x @ net.w["attend"]) @ net.w["focus"]) for x in inside]
        pool = sum(w * x for w, x in zip(weight, inside, strict=True)) / sum(weight) if inside else np.zeros(24)
        out.append(float(pool @ net.w["out"] + net.w["bias"][0]))
    return out


def test_score_equals_plain_loops():
    net = toxicity.Network.fresh({b"w1": 1, b"w7": 2})
    texts = [" ".join(f"w{i * i % k}" for i in range(n)) for n, k in ((0, 1), (1, 3), (31, 7), (32, 11), (33, 5), (95, 29), (96, 31), (150, 13), (230, 61))]
    want, tops = [], []
    for t in texts:
        words = t.encode().split()
        logits = [x for f, s, w in zip(*toxicity.passes(len(words)), strict=True) for x in plain_windows(net, words[f : f + s])[:w]]
        assert len(logits) == max(1, len(words) - 31)
        want.append(1 / (1 + np.exp(-max(logits))))
        tops.append(int(np.argmax(logits)))
    assert net.score(texts) == pytest.approx(want, abs=1e-5)
    assert [float(net.score([t])[0]) for t in texts] == pytest.approx(want, abs=1e-5)
    assert any(t % 16 for t in tops) and any(t > toxicity.SPAN for t in tops)  # the highest window may start at any word


def test_gradient_pools_the_window():
    rng = np.random.default_rng(13)
    net = toxicity.Network.fresh({})
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.standard_normal((3, 9, 28)) * 0.5, np.array([1.0, 0, 1])
    mask = (np.arange(9) < np.array([9, 7, 4])[:, None]).astype(float)
    window = mask * ((np.arange(9) >= np.array([2, 0, 1])[:, None]) & (np.arange(9) < np.array([6, 4, 4])[:, None]))
    grads, d_x, _ = net.gradient(x, mask, y, window)
    for name in ("xf", "ub", "attend", "focus"):
        at = tuple(rng.integers(0, n) for n in net.w[name].shape)
        keep, losses = net.w[name][at], []
        for e in (1e-2, -1e-2):
            net.w[name][at] = keep + e
            losses.append(net.gradient(x, mask, y, window)[2])
        net.w[name][at] = keep
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=1e-5)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0), (1, "a b", 6.0), (1, "c " * 9000, 7.0), (None, None, 8.0), (2, "x" * 5000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.document_toxicity(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 2  # the same rows score alike


def test_samples_are_bounded_whatever_repeats(spark):
    from tarnfield.llm.sampling import bounded_sample

    rows = spark.createDataFrame([(i % 900 if i % 3 else 0, "ab"[i % 2]) for i in range(5400)] + [(7, None)], "x long, kind string")
    got = bounded_sample(rows, F.col("kind"), F.xxhash64("x"), 40)
    assert len(got) == 80 and len({(k, r["x"]) for k, r in got}) == 80
    assert got == bounded_sample(rows.repartition(9), F.col("kind"), F.xxhash64("x"), 40)
    assert len(bounded_sample(rows, F.col("kind"), F.xxhash64("x"), 10_000)) == rows.where("kind is not null").distinct().count()


def test_toxicity_learns_and_is_held_out(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "r", "st", "mp")]
    rows = []
    for i in range(400):
        words = rng.choice(vocabulary, 60).tolist()
        if i % 4 == 0:
            for at in rng.choice(60, 4):
                words[at] = "vile" + rng.choice(["ly", "ness", "", "st"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1), (901, None)], "doc_id long, toxic int")
    out = toxicity.document_toxicity(docs, labels).toPandas().set_index("doc_id")
    assert len(out) == 402 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.index]).all()
    y = np.array([dict((i, y) for i, _, y in rows).get(i, 0) for i in out.index])
    assert (out.predicted[out.held_out] == y[out.held_out.to_numpy()]).mean() > 0.95
    assert toxicity.document_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_long_words_are_read_to_their_end():
    net = toxicity.Network.fresh({})
    a, b = net.score(["中文字" * 20 + "好" * 10, "中文字" * 20 + "坏" * 10])
    assert a != b
    word = bytes(np.random.default_rng(5).integers(97, 123, 200).tolist())
    for n in (1, 63, 64, 65, 124, 125, 200):
        pieces = toxicity.words_of(word[:n].decode())
        assert {word[i : i + 5] for i in range(n - 4)} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
        assert pieces[-1].endswith(word[n - 1 : n]) and max(map(len, pieces)) <= 64


# --- 4: language ---


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.text_model(docs)
    got = language.document_languages(docs.withColumn("lang", F.lit(None).cast("string")), model).select("doc_id", "lang_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_id).mean() > 0.97
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.b/", '<html lang="fr">'), (3, "x", "<script>the and</script>"), (None, "http://u@a.b.c:8/x?", "<p>the and of the thing</p>"), (None, "http://a.b.c/", "<p>the and of the thing</p>")], "page_id long, url string, html string")
    out = {(r["page_id"], r["lang_id"], r["suffix"], r["declared"]) for r in language.page_languages(pages, docs).collect()}
    assert out == {(1, "und", "", ""), (2, "und", "b", "fr"), (3, "und", "", ""), (None, "en", "c", "")}
    assert language.page_languages(pages.limit(0), docs.limit(0)).count() == 0


def test_host_prior_decides_what_text_leaves_open(spark):
    model = language.fit_text([b"aaa aab", b"bbb bba"], ["xx", "yy"])
    rows = spark.createDataFrame([(i, "aaa aab aaa", "h.one.com", "one.com", "com") for i in range(20)] + [(20 + i, "bbb bba bbb", "g.two.org", "two.org", "org") for i in range(20)] + [(99, "qqq", "h.one.com", "one.com", "com"), (98, "qqq", "", "", "")], "id int, body string, host string, domain string, suffix string")
    got = {r["id"]: r["confidence"] for r in language.fused(rows, model, "body", language._plain, 0.0).collect() if r["id"] > 90}
    assert got[99] > 0.9 > got[98]


def test_every_labelled_language_is_modelled(spark):
    def words(i):
        return " ".join("".join(chr(97 + x) for x in np.random.default_rng([i, j]).integers(0, 26, 4)) for j in range(12))

    rows = [(i, f"l{i:02}", words(i)) for i in range(70)] + [(70, "long", "vyzq kwjx " * 3000)]
    names, table = model = language.text_model(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert names == [*(f"l{i:02}" for i in range(70)), "long"] and table.shape == (language.BUCKETS, 71)
    asked = [(i, None, "s", words(i)) for i in (0, 69)] + [(70, None, "s", "kwjx vyzq kwjx"), (71, None, "s", "Это проверка определения языка этого текста")]
    got = {r["doc_id"]: r["lang_id"] for r in language.document_languages(spark.createDataFrame(asked, "doc_id long, lang string, source string, text string"), model).collect()}
    assert got == {0: "l00", 69: "l69", 70: "long", 71: "und"}


def plain_fusion(model, rows):
    """(language, confidence) of each (body, host, domain, suffix, declared), by loops over the definitions."""
    import math

    names, table = model
    k, scale = len(names), 1_000_000

    def shares(logs):
        return [1 / math.fsum(math.exp(y - x) for y in logs) for x in logs]

    seen = []
    for body, *keys in rows:
        grams = language.trigrams((body or "").encode())
        n = len(grams) if len(grams) > 1 else 0
        means = [round(math.fsum(float(table[g, i]) for g in grams) / n, 9) if n else 0.0 for i in range(k)]
        like = n > 0 and max(means) >= language.UNLIKE
        logs = [m * min(n, 30.0) for m in means]
        seen.append((n, like, logs, [math.floor(p * scale + 0.5) if like else 0 for p in shares(logs)], keys))
    sums = [{} for _ in range(4)]  # host, domain, suffix, declared
    total = [sum(x[3][i] for x in seen) for i in range(k)]
    for _, _, _, r, keys in seen:
        for by, key in zip(sums, keys, strict=True):
            if key:
                by[key] = [a + b for a, b in zip(by.get(key, [0] * k), r, strict=True)]
    every = [x / scale for x in total]
    base = [(x + 1) / (sum(every) + k) for x in every]
    out = []
    for n, like, logs, r, keys in seen:
        host, domain, suffix, declared = ([max((a - b) / scale, 0.0) for a, b in zip(by[key], r, strict=True)] if key else [0.0] * k for by, key in zip(sums, keys, strict=True))
        prior = base if not keys[1] else [(c + 20 * b) / (sum(domain) + 20) for c, b in zip(domain, base, strict=True)]
        prior = prior if not keys[0] else [(c + 10 * b) / (sum(host) + 10) for c, b in zip(host, prior, strict=True)]
        share = sum(suffix) / max(sum(every), 1.0)
        of_suffix = [1.0] * k if not keys[2] else [(c + 200 * share + 1e-6) / (e + 200) for c, e in zip(suffix, every, strict=True)]
        aims = [0.8 if name == keys[3] else 0.2 / k for name in names]
        of_code = [1.0] * k if not keys[3] else [(c + 5 * a + 1e-6) / (e + 5) for c, a, e in zip(declared, aims, every, strict=True)]
        q = [round(x, 6) for x in shares([t + math.log(p) + math.log(s) + math.log(d) for t, p, s, d in zip(logs, prior, of_suffix, of_code, strict=True)])]
        best = max(q)
        out.append((names[q.index(best)] if like and best >= language.SURE else "und", best if n else 0.0))
    return out


def test_fusion_equals_plain_loops(spark):
    rng = np.random.default_rng(29)
    bodies = {"xx": "aaab abaa baab aaba", "yy": "bbba babb abba", "zz": "cabc bcca abcc"}
    model = language.fit_text([b.encode() for b in bodies.values()], list(bodies))
    rows = []
    for _ in range(70):
        lang = str(rng.choice(list(bodies)))
        words = rng.choice(bodies[lang].split(), int(rng.integers(0, 6))).tolist()
        host = str(rng.choice(["h.one.com", "g.one.com", "two.org", ""]))
        domain = ".".join(host.split(".")[-2:]) if host else ""
        rows.append((" ".join(words), host, domain, domain.split(".")[-1], str(rng.choice([lang, "xx", "", "qq"]))))
    rows += [(None, "", "", "", ""), ("Это не то", "h.one.com", "one.com", "com", "xx"), rows[3], rows[3]]
    frame = spark.createDataFrame([(i, *r, 1.5) for i, r in enumerate(rows)], "id int, body string, host string, domain string, suffix string, _declared string, lang_id double").drop("lang_id")
    got = {r["id"]: (r["lang_id"], r["confidence"]) for r in language.fused(frame, model, "body", language._plain).collect()}
    for i, (lang, sure) in enumerate(plain_fusion(model, rows)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(sure, abs=2e-6), (i, rows[i])
    assert len({lang for lang, _ in got.values()}) == 4


def test_open_tags_take_time_in_proportion():
    import time

    began = time.perf_counter()
    for page in ("<script " * 200_000, "<" * 1_000_000, "<html " * 200_000, "<meta content-language " * 100_000, "<!-- " * 200_000):
        text, code = language.page_parts(page + "x")
        assert code == ""
    assert language.page_parts("<p>a < b</p><script>no")[0].split() == ["a", "<", "b"]
    assert time.perf_counter() - began < 20


# --- 5: shingle join ---


def brute_components(rows, words=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), i if not s else least.get(r)) for (i, _), s, r in zip(rows, sets, root, strict=True)]


def test_shingle_join(spark, odd):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(120)]
    near = []
    for i in range(60):  # one group of near copies and one common line
        w = list(base)
        for at in rng.choice(120, i % 5, replace=False):
            w[at] = f"e{i}_{at}"
        near.append((100 + i, " ".join(w)))
    line = "this common line stands in many texts and says little"
    near += [(300 + i, line + " " + " ".join(f"{chr(97 + i % 26)}{i}_{j}" for j in range(3 + i % 40))) for i in range(60)]
    rows = ODD + near
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = keyed(brute_components(rows))
    assert keyed(map(tuple, shingle_join.document_components(frame).collect())) == want
    # The answer doesn't depend on which tokens count as frequent.
    for least, step in ((3, 2), (2, 100)):
        other = shingle_join.text_components(frame, least=least, step=step).select("doc_id", "n_shingles", "component_id")
        assert keyed(map(tuple, other.collect())) == want
    clash = shingle_join.text_components(odd.withColumn("n_shingles", F.lit(-1)).withColumn("component_id", F.lit("x")))
    assert keyed((r["doc_id"], r["n_shingles"], r["component_id"]) for r in clash.collect()) == keyed(brute_components(ODD))
    assert shingle_join.document_components(odd.limit(0)).count() == 0


def test_a_pair_is_made_in_its_lowest_list_only(spark, monkeypatch):
    made, given = [], type(spark.range(1).groupBy("id")).applyInArrow
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", lambda *args: made.append(given(*args)) or made[-1])
    box = bytearray(shingle_join.cells(np.arange(10, dtype=np.uint64)))
    # 1 and 2 share forty lists; 3 and 4 only such as come after all that either tells of itself
    own = {0: range(100), 1: range(40), 2: range(40), 3: [*range(200, 250), 900, 901], 4: [*range(300, 350), 900, 901], 9: [900, 901]}
    rows = [(sig, tid, 10, box, tid, 9 if sig > 199 else 0, 3, sorted(sigs)[:32]) for tid, sigs in own.items() for sig in sigs]
    lists = spark.createDataFrame(rows, "sig long, tid long, n long, cells binary, root long, pivot long, members long, low array<long>")
    got = {(r["a"], r["b"]) for r in shingle_join._across(lists, 64, 90).collect()}
    assert got == {(1, 2), (3, 4)}
    assert made[0].where("a = 1").count() == 1


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    frequent = pool[:2500]
    counts = rng.integers(20, 5000, len(frequent))
    rank = np.argsort(np.lexsort((frequent, counts)))
    for n in [9, 10, 20, 31, 32, 33, 35, 36, 63, 64, 66, 71, 128, 140, 142, 300, 1000]:
        for _ in range(12):
            x = rng.choice(pool, n, replace=False)
            gone = rng.integers(0, n // 10 + 1)
            new = rng.integers(0, n // 10 + 1)
            y = np.concatenate([x[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)])
            a, b = np.unique(x), np.unique(y)
            o = len(np.intersect1d(a, b))
            if 100 * o >= 90 * (len(a) + len(b) - o):
                for step in (100, 3):  # classes up to 3, and up to 7
                    sa, sb = (shingle_join.signatures(s, frequent, counts, rank, 90, 20, step)[0] for s in (a, b))
                    assert len(np.intersect1d(sa, sb)), (n, gone, new)


def test_frequent_tokens_fit_the_table(spark):
    texts = spark.createDataFrame([(" ".join(f"t{i} u{i} v{i}" for i in range(60) if j % (i + 1) == 0),) for j in range(240)], "text string").coalesce(1)
    whole, counts = shingle_join.frequent_tokens(Workspace(spark, "test"), texts, 1, 2)
    few, most = shingle_join.frequent_tokens(Workspace(spark, "test"), texts, 1, 2, 20)
    assert len(whole) == 180 and 0 < len(few) <= 20 and set(few) <= set(whole) and most.min() > np.sort(counts)[-21]


def test_one_of_each(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a, "z"), (None, a, "y"), (None, a + " more", "x"), (7, b, "q"), (7, b, "p"), (None, b + " c", "a"), (5, "", "e"), (5, "", "e"), (6, None, "e"), (8, " \n", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = keyed(map(tuple, shingle_join.one_of_each(frame).collect()))
    assert got == keyed([(None, a + " more", "x"), (7, b, "p"), (5, "", "e"), (5, "", "e"), (6, None, "e"), (8, " \n", None)])
    assert shingle_join.one_of_each(frame.limit(0)).count() == 0


# --- 6: embeddings ---


def clustered():
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 32))
    x = np.concatenate([centre[i] + rng.standard_normal((12, 32)) * 0.12 for i in range(40)] + [centre[0] + rng.standard_normal((150, 32)) * 0.01])
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def linked(rows):
    u = np.array([v for _, v in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    return link


def test_pivots(spark):
    rows = clustered()
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] + [1.0] * 31), (1003, [None] + [1.0] * 31), (None, rows[0][1]), (1004, [])]
    got = {r["vec_id"]: r for r in pivots.near_embeddings(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    link = linked(rows)
    n = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.95 * link.sum()
    assert all(got[i]["component_id"] <= i and got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(rows)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in odd)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.near_embeddings(empty).count() == 0


def test_pivots_of_mixed_lengths_repeated_ids_and_clashing_columns(spark):
    a, b = [1.0, 0.1], [1.0, 0.11]
    rows = [(1, a, 5), (2, b, 5), (3, [1.0, 0.1, 0.0], 5), (4, [0.0, 1.0], 5), (2, b, 5)]
    for parts in (1, 5):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int").repartition(parts)
        got = keyed((r["vec_id"], r["n_links"] > 0, r["component_id"], r["kept"]) for r in pivots.near_vectors(frame).collect())
        assert got == keyed([(1, True, 1, True), (2, True, 1, False), (2, True, 1, False), (3, False, 3, True), (4, False, 4, True)])


def test_halos_and_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(17)
    core = rng.standard_normal(32)
    near = [core + rng.standard_normal(32) * s for s in np.repeat([0.01, 0.2, 0.28, 0.33], 70)]  # a ball, its halo, and beyond
    rows = [(i, v.tolist()) for i, v in enumerate(near + [rng.standard_normal(32) for _ in range(60)])]
    link = linked(rows)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points, leaders = pivots.fit(x, len(x))
    angle = np.degrees(np.arccos(np.clip(x @ leaders.T, -1, 1))).min(1)
    assert len(leaders) and (angle <= pivots.BALL).sum() > 60 and ((angle > pivots.BALL) & (angle < 3 * pivots.BALL)).sum() > 60
    for block in (2048, 16):
        monkeypatch.setattr(pivots, "BLOCK", block)
        got = {r["vec_id"]: r for r in pivots.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        n = np.array([got[i]["n_links"] for i in range(len(rows))])
        assert (n <= link.sum(1)).all() and n.sum() >= 0.98 * link.sum()
        inside = angle <= pivots.BALL
        assert (n[inside] == link.sum(1)[inside]).all()  # links into balls are all found


# --- 7: substrings ---


def brute_dedup(rows):
    words = [(t or "").encode().split() for _, t in rows]
    count = collections.Counter(tuple(w[s : s + 35]) for w in words for s in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_superkmers(spark, odd):
    passage = " ".join(f"p{i}" for i in range(60))
    more = [(200 + i, f"{i} before {i} {passage} after {i} {i}") for i in range(40)] + [(300, LONG + " " + passage)]
    rows = ODD + more
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = keyed(brute_dedup(rows))
    assert keyed(map(tuple, superkmers.deduplicated_documents(frame).collect())) == want
    small = superkmers.drop_repeats(frame.withColumn("kept", F.lit(1)).withColumn("start", F.lit(2)), flush_bytes=3000, part_bytes=2000)
    assert keyed(map(tuple, small.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())) == want
    assert superkmers.deduplicated_documents(frame.limit(0)).count() == 0


def test_frequent_runs_fit_their_table(spark):
    texts = [(" ".join(f"a{i} b{i} c{i} d{i}" for i in range(80) if (j * 7 + i) % (1 + i % 9) == 0),) for j in range(900)]
    rows = spark.createDataFrame(texts, "_text string").coalesce(1)
    every, few = (superkmers.frequent_runs(Workspace(spark, "test"), rows, 1000, 60_000, 2, most) for most in (1 << 20, 60))
    assert len(every) > 60 >= len(few) > 0 and set(few) <= set(every)


def test_rolled_hash_is_of_the_run():
    h = np.random.default_rng(8).integers(0, 2**63, 200, dtype=np.uint64)
    for n in (1, 2, 3, 5, 35, 64):
        whole = superkmers.rolled(h, n)
        assert len(whole) == 201 - n and whole[7] == superkmers.rolled(h[7 : 7 + n], n)[0]
        assert (superkmers.sliding_min(h, n) == np.lib.stride_tricks.sliding_window_view(h, n).min(1)).all()


# --- 8: pieces ---


def test_pieces_equal_the_library(spark, odd, small):
    sentencepiece = pytest.importorskip("sentencepiece")
    peer = sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)
    machine = wfst.Transducer(wfst.read_model(wfst.MODEL))
    texts = [t or "" for _, t in ODD] + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    texts += [" ", "  two  spaces ", "a\u2581b", "\x00\r\n\t", "x" * 3000, "日本語 🙂🙃", "if x:\n        return f(x)"]
    for t in texts:
        assert list(machine.encode(t)) == peer.encode(t)
        assert machine.decode(machine.encode(t)) == t.replace("\u2581", " ")
    got = {(r["doc_id"], r["n_pieces"], r["round_trip"]) for r in wfst.document_pieces(odd).collect()}
    assert got == {(i, len(peer.encode(t or "")), "\u2581" not in (t or "")) for i, t in ODD}
    ids = wfst.encode_texts(odd.withColumn("ids", F.lit(1)), wfst.read_model(wfst.MODEL))
    back = wfst.decode_ids(ids, wfst.read_model(wfst.MODEL))
    assert back.where("decoded <> replace(coalesce(text, ''), '\u2581', ' ')").count() == 0
    both = wfst.encode_texts(odd.withColumn("decoded", F.lit(2)), wfst.read_model(wfst.MODEL), decoded=True)
    assert keyed((r["doc_id"], r["ids"], r["decoded"]) for r in both.collect()) == keyed((r["doc_id"], r["ids"], r["decoded"]) for r in back.collect())
    assert wfst.document_pieces(odd.limit(0)).count() == 0


def serialised(fields):
    """A message from (number, value): whole numbers, single-precision floats, texts, bytes, or lists of fields."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += varint(n << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else serialised(v) if isinstance(v, list) else v
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


def small_model(kind, pieces, bytes_=True, charsmap=b"", prefix=1, collapse=0):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if bytes_] + [(p, s, 1) for p, s in pieces]
    return serialised([*[(1, [(1, p), (2, s), (3, k)]) for p, s, k in rows], (2, [(3, kind), (35, int(bytes_))]), (3, [(1, "own"), (2, charsmap), (3, prefix), (4, collapse), (5, 1)])])


def test_pieces_of_unigram_models_and_character_maps():
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = np.random.default_rng(11)
    letters = "abcde\u2581"
    pieces = dict.fromkeys(letters, -9.0)
    while len(pieces) < 140:
        p = "".join(rng.choice(list("abcde"), rng.integers(2, 6)))
        pieces[("\u2581" if rng.random() < 0.3 else "") + p] = float(np.float32(-rng.integers(20, 90) / 8))  # many ties
    pieces["\u2581\u2581"] = -4.5
    charsmap = b""
    try:
        maker = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
        (charsmap,) = [v for n, spec in wfst._fields(maker.serialized_model_proto()) if n == 3 for k, v in wfst._fields(spec) if k == 2]
    except (AttributeError, TypeError):
        pass
    texts = ["", " ", "  ", "abc", " abcde  dcba", "a\u2581b", "xyz abc xy", "\uff21bc \uff41\uff42 \u2460 \ufb01 \u00a0 e\u0301 \u3000a\t\nb ", "\u1100\u1161 \ufdfa a"]
    texts += ["".join(rng.choice(list("abcdex  "), rng.integers(1, 60))) for _ in range(300)]
    seen = set()
    for kind in (1, 2):
        for bytes_ in (True, False):
            for marks, prefix, collapse in ((b"", 1, 0), (b"", 0, 1), (charsmap, 1, 1), (charsmap, 1, 0)):
                scored = list(pieces.items()) if kind == 1 else [(p, -float(i)) for i, p in enumerate(sorted(pieces, key=lambda p: (len(p), p)))]
                model = small_model(kind, scored, bytes_, marks, prefix, collapse)
                peer, machine = sentencepiece.SentencePieceProcessor(model_proto=model), wfst.Transducer(model)
                for t in texts:
                    assert list(machine.encode(t)) == peer.encode(t), (kind, bytes_, prefix, collapse, t)
                seen.add((kind, len(machine.normalise.rules) > 1000))
    assert (1, True) in seen or not charsmap


def test_path_weighs_least():
    pieces = {"a": -3.0, "b": -2.5, "ab": -4.25, "ba": -6.0, "aba": -7.5, "\u2581": -1.0}
    machine = wfst.Transducer(small_model(1, list(pieces.items())))

    def least(text):
        if not text:
            return 0.0
        return min(least(text[n:]) - pieces[text[:n]] for n in (1, 2, 3) if text[:n] in pieces)

    for n in range(1, 256):
        text = "".join("ab"[int(c)] for c in f"{n:b}")
        back = {i: p for p, i in machine.ids.items()}
        assert sum(-pieces[back[i]] for i in machine.encode(text)) == least("\u2581" + text)


def test_piece_query_digests(spark, odd):
    import struct

    sentencepiece = pytest.importorskip("sentencepiece")
    peer = sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)
    rows = [(20, "x" * 300_000), (21, "ab" * 20_000 + "\u2581" + "é" * 9000)]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("n_pieces", F.lit("clash"))
    got = keyed((r["doc_id"], r["n_pieces"], r["ids_sha256"], r["decoded_sha256"]) for r in wfst.document_pieces(frame).collect())
    want = []
    for i, t in [*ODD, *rows]:
        ids = peer.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}i", *ids)).hexdigest(), hashlib.sha256((t or "").replace("\u2581", " ").encode()).hexdigest()))
    assert got == keyed(want)


# --- 9: licences ---


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Someone. All rights reserved.\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-license").replace(", ", " ; ")), (3, mit[:-20]), (4, None), (5, ""),
        (6, "Text.\nReleased under the MIT licence!\nmore"), (None, "Licensed under CC BY 4.0."), (6, "Text.\nReleased under the MIT licence!\nmore"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit(5))
    got = keyed((r["doc_id"], r["license_id"], ",".join(r["notice_ids"])) for r in licences.license_scan(frame).collect())
    assert got == keyed([(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "MIT"), (6, None, "MIT"), (None, "CC-BY-4.0", "CC-BY-4.0")])
    assert licences.license_scan(frame.limit(0)).count() == 0


def test_licences_that_callers_know(spark, duck):
    known = (("Own-1", "Use freely."), ("Own-0", "USE freely!"), ("Two", "first line\nsecond line"), ("None", "Copyright 2020 X"))
    rows = [(1, "use FREELY"), (2, "say\n  Use: freely \nmore"), (3, "First\n line, second line"), (4, "x " * 400_000 + "\nuse freely"), (5, "Copyright 2021 Y"), (6, "first line\nno")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], ",".join(r["notice_ids"])) for r in licences.license_scan(frame, known, digests=()).collect()}
    assert got == {1: ("Own-0", "Own-0"), 2: (None, "Own-0"), 3: ("Two", ""), 4: (None, "Own-0"), 5: ("None", ""), 6: (None, "")}


def test_published_licences_are_found(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    given = [(i, (folder / f).read_text()) for f, i in files.items() if (folder / f).exists()]
    if not given:
        pytest.skip("no licence texts here")
    rows = [(i, t.upper().replace("\n", "\r\n")) for i, t in given] + [(f"not {i}", t + " But.") for i, t in given] + [("Unlicense", licences._UNLICENSE)]
    found = {r["doc_id"]: r["license_id"] for r in licences.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(found[i] == i and found.get(f"not {i}") is None for i, _ in rows if not i.startswith("not"))


def test_licence_sql_sees_planted_texts(spark, duck, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(licences.KNOWN)] + [(100, None), (101, "x\nCopyright (c) 1999\n\u00a9 2001 a\nLicensed under CC0 1.0"), (102, "  (C) All rights reserved\nReleased under the MIT\u2014Licence."), (103, "a\n\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(licences.document_licenses(frame).toPandas())
    assert got == rows_of(duck.execute(licences.LICENSE_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchdf())
    assert {i for i, _ in licences.KNOWN} <= {r[2] for r in got[1]}


# --- 10: mixing ---


def test_mixing(spark, odd):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), ["big", "big", "big", "mid", "low", None][i % 6]) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(frame).toPandas()
    assert len(out) == 900 and (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"] == 0).all()
    assert abs(out.taken.sum() - out["size"].sum()) <= 7
    groups = out.assign(source=[str(rows[i][2]) for i in out.doc_id]).groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), total=("size", "sum"))
    assert (groups["size"] == groups.total).all() and abs(groups.target.sum() - groups.total.sum()) < 1e-6
    assert ((groups.target - groups.taken).abs() <= 7).all() and (groups.target <= 3 * groups.total + 1e-9).all()
    weights = dict(zip(["big", "low", "mid", "None"], [1, 2, 3, 1], strict=True))
    level = [t / weights[s] for s, t in groups.target.items() if t < 3 * groups.total[s] - 1e-9]
    assert max(level) - min(level) < 1e-6
    assert sorted(out.itertuples(index=False)) == sorted(mixing.mixed_documents(frame.repartition(7)).toPandas().itertuples(index=False))
    assert mixing.mixed_documents(odd).count() == len(ODD)
    assert mixing.mixed_documents(odd.limit(0)).count() == 0


def test_mixing_counts_words_between_any_marks(spark, duck, tmp_path):
    rows = [(1, "a b \u0085", "s"), (2, "a\u2028 b", "s"), (3, "a" + " " * 1_000_000 + "b", "s"), (4, "\u00a0", None), (5, " \t\r\n", None), (6, None, "t"), (None, "x " * 50, "t"), (7, "same words", "u"), (7, "same words", "u"), (7, "same words", "u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(frame)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got.collect()) == [(0, 50), (1, 3), (2, 2), (3, 2), (4, 1), (5, 0), (6, 0), (7, 2), (7, 2), (7, 2)]
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    sql = mixing.MIX_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(got.toPandas()) == rows_of(duck.execute(sql).fetchdf())


def test_mixing_gives_rows_back_with_their_texts(spark):
    rows = [(i % 40, " ".join(["w"] * (1 + i % 40 % 7)), ["big", "low", None][i % 40 % 3], i % 40 % 2, 9, "k") for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int, size int, _copies string")
    whole, narrow = (mixing.fair_mix(frame, with_text=x) for x in (True, False))
    assert whole.columns == ["doc_id", "text", "source", "extra", "_copies", "size", "source_size", "target", "taken"]
    assert keyed(map(tuple, whole.drop("text").collect())) == keyed(map(tuple, narrow.collect()))
    assert whole.where("size <> length(replace(text, ' ', ''))").count() == 0 and whole.count() == 120


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, small, duck):
    got = rows_of(queries.queries()[name](spark, small).toPandas())
    assert got == rows_of(duck.execute(queries.oracle_sql()[name]).fetchdf())
