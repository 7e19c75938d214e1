"""Small tables and brute force for the operators on documents."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, components, exact_dedup, license_scan, lm_score, mixing, near_dedup, pii, quality, shared, shingles

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def collect(df):
    return df.collect()


# exact dedup


def dedup_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((len(t or ""), -i if i is not None else -math.inf, i))
    out = []
    for norm, members in groups.items():
        keep = max(members, key=lambda m: m[:2])[2]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [None, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), lambda t: F.unhex(F.lit("00"))])
def test_exact_dedup(docs, digest):
    """With a weak digest, distinct texts meet in one state and are told apart by their bytes."""
    df = docs()
    got = exact_dedup.exact_dedup(df, digest=digest).drop("keep_at")
    assert sorted(map(tuple, got.collect()), key=repr) == dedup_brute([tuple(r)[:2] for r in df.collect()])


def test_exact_dedup_empty(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0


def test_exact_dedup_stage(spark, docs):
    df = docs()
    out = exact_dedup.stage(spark, df, "")
    assert out.columns == df.columns
    assert len(collect(out)) == len({SPACE.sub("", r.text or "") for r in df.collect()})


def test_exact_dedup_state(spark, docs, tmp_path):
    """A state that outlives the call: later documents meet earlier ones, and a text that only shares their digest does not."""
    weak = lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1).cast("string").substr(1, 0))  # noqa: E731  (one digest for all)
    first = docs([(1, "a b", "en", "a"), (2, "c", "en", "a"), (3, "c", "en", "a")])
    second = docs([(4, "a  b", "en", "a"), (5, "c", "en", "a"), (6, "d", "en", "a")])
    for name, digest in (("strong", None), ("weak", weak)):
        state = f"{tmp_path}/{name}"
        one = exact_dedup.exact_dedup(first, digest=digest, state=state).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in one) == [(1, 1, 1), (2, 2, 2), (3, 2, 2)]
        two = exact_dedup.exact_dedup(second, digest=digest, state=state, known=first).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in two) == [(4, 4, 2, True), (5, 2, 3, False), (6, 6, 1, True)]


def test_exact_dedup_state_of_earlier_calls(spark, docs, tmp_path):
    """Earlier texts must be given; a call that is repeated by its name counts once."""
    first, second, state = docs([(1, "a b", "en", "a")]), docs([(2, "a  b", "en", "a")]), f"{tmp_path}/state"
    for _ in range(2):
        got = exact_dedup.exact_dedup(first, state=state, run="monday").collect()
        assert [(r.doc_id, r.group_size) for r in got] == [(1, 1)]
    with pytest.raises(ValueError, match="known"):
        exact_dedup.exact_dedup(second, state=state)
    for _ in range(2):
        got = exact_dedup.exact_dedup(second, state=state, known=first, run="tuesday").collect()
        assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(2, 2, 2, True)]


CLASHES = ("_id", "_sum", "_own", "_times", "_row", "_key", "_copies", "_copy", "_p", "_kinds", "_m", "_d", "_s", "_step", "row", "key", "copies", "sum", "times", "doc id.x")


@pytest.mark.parametrize("stage", [exact_dedup.stage, near_dedup.stage, mixing.stage])
def test_stages_keep_columns_of_any_name(spark, docs, stage):
    df = docs()
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    out = stage(spark, df, "")
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[name] == "clash" for r in rows for name in CLASHES)
    assert stage(spark, df.limit(0), "").count() == 0


def test_exact_dedup_stage_ids(spark, docs):
    """An identifier that is null or stands for several texts: each text stays once, as its kept row."""
    rows = [(None, "one text", "en", "a"), (None, "another text", "en", "a"), (None, "a third", "en", "a"), (3, "same words", "en", "a"), (7, "own words", "en", "a"), (7, "same words", "en", "a"), (8, "p q", "en", "a"), (8, "r s", "en", "a"), (9, "x y", "en", "a"), (9, "x  y", "en", "b")]
    got = exact_dedup.stage(spark, docs(rows), "").select("doc_id", "text").collect()
    want = [(None, "one text"), (None, "another text"), (None, "a third"), (3, "same words"), (7, "own words"), (8, "p q"), (8, "r s"), (9, "x  y")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# near dedup


def near_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(spark, docs):
    """Chains around the threshold, many edits of one text, and the small table."""
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"z{r.randrange(99)}"
        rows.append((1000 + i, " ".join(w), None, None))
    rows += [tuple(x)[:4] for x in docs(extra=False).collect() if x.doc_id is not None]
    want = near_brute([x[:2] for x in rows], 3, 85)
    got = near_dedup.near_dedup(docs(rows), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got) and len(got) == len(rows)


@pytest.mark.parametrize("block", [3, 1000])
def test_near_dedup_linked_apart(spark, monkeypatch, block):
    """Links between members around one text: exactly those of brute force, many sharing few shingles or many."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r, rows, want = random.Random(block), [], set()
    for b, size in ((1, 40), (2, 100), (3, 7)):
        centre, members = set(range(size)), {}
        passages = [set(range(1000 + 50 * k, 1000 + 50 * k + size // 4)) for k in range(4)]
        for i in range(60):
            x = centre - set(r.sample(sorted(centre), r.randrange(size // 3 + 1)))
            x |= set(r.sample(range(size, 2 * size), r.randrange(size // 3 + 1))) if i % 3 else r.choice(passages)
            if i and i % 4 == 0:  # close to an earlier one
                x = set(r.choice(list(members.values()))[0]) ^ {r.randrange(2 * size)}
            if x != centre:
                near = 100 * len(x & centre) >= 85 * len(x | centre)
                members[100 * b + i] = (x, 0 if near else r.choice([100 * b + i, 7, 8]))
        rows += [(i, b, part, size, sorted(centre - x), sorted(x - centre)) for i, (x, part) in members.items()]
        for i, (x, p) in members.items():
            want |= {frozenset([i, j]) for j, (y, q) in members.items() if i != j and p != q and 100 * len(x & y) >= 85 * len(x | y)}
    apart = spark.createDataFrame(rows, "a long, b long, part long, size long, lacks array<long>, adds array<long>")
    got = near_dedup.linked_apart(apart, 85, near_dedup.Work(spark, "apart-test")).collect()
    assert len(want) > 50 and sorted(map(sorted, ({x.a, x.b} for x in got))) == sorted(map(sorted, want))


def test_near_dedup_edges(docs):
    assert near_dedup.near_dedup(docs([])).count() == 0
    rows = near_dedup.near_dedup(docs([(None, "a b c d e f", "", ""), (5, "a b c d e f", "", ""), (None, None, "", "")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("5", "5", True), ("None", "5", False), ("None", "None", True)]


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_hot_keys_are_joined_apart(spark, docs, monkeypatch, hot):
    """No key hot, some, or all: the same rows; a null key has none. Dedup is unchanged by where the line is."""
    monkeypatch.setattr(shared, "HOT", hot)
    keys = ["a"] * 40 + ["b"] * 20 + list("cdefgh") * 3 + [None] * 5
    rows = spark.createDataFrame(list(enumerate(keys)), "doc_id long, k string")
    groups = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("times"))
    got = shared.joined_by_size(rows, groups, "k", "times").select("doc_id", "k", "times").collect()
    assert sorted(map(tuple, got)) == [(i, k, keys.count(k)) for i, k in enumerate(keys) if k]
    assert shared.joined_by_size(rows.limit(0), groups.limit(0), "k", "times").count() == 0
    df = docs()
    exact = exact_dedup.exact_dedup(df).drop("keep_at").collect()
    assert sorted(map(tuple, exact), key=repr) == dedup_brute([tuple(r)[:2] for r in df.collect()])
    near = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_dedup(df.filter("doc_id is not null"), 3, 85).collect()}
    assert near == near_brute([tuple(r)[:2] for r in df.filter("doc_id is not null").collect()], 3, 85)


def test_near_dedup_bridge_without_id(docs):
    """A row without a doc_id links those on its two sides, and groups of such rows alone keep one."""
    w = [f"w{i}" for i in range(60)]
    middle, one, two = w, ["x"] + w[1:], w[:-1] + ["y"]
    other = [f"v{i}" for i in range(50)]
    rows = [(1, " ".join(one), "", ""), (None, " ".join(middle), "", ""), (2, " ".join(two), "", ""), (None, " ".join(other), "", ""), (None, " ".join(other[:-1]), "", ""), (None, " ".join(other), "", "")]
    got = near_dedup.near_dedup(docs(rows), 3, 96).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (2, 1, False)]
    assert sorted(((r.component_id, r.kept) for r in got if r.doc_id is None), key=repr) == [(1, False), (None, False), (None, False), (None, True)]
    far = near_dedup.near_dedup(docs([rows[0], rows[2]]), 3, 96).collect()
    assert {r.component_id for r in far} == {1, 2}


def test_components_of_a_hot_id(spark):
    """A star of many links, a chain and a pair, against a plain search; repeated and turned links change nothing."""
    links = [(7, 100 + i) for i in range(1500)] + [(5001 + i, 5000 + i) for i in range(6)] + [(9001, 9000), (9000, 9001), (3, 100)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), near_dedup.Work(spark, "components-test")).collect()
    want = {i: 3 for i in (3, 7, *range(100, 1600))} | {5000 + i: 5000 for i in range(7)} | {9000: 9000, 9001: 9000}
    assert len(found) == len(want) and {x.id: x.component for x in found} == want


def test_joined_by_size(spark):
    """Hot keys and others get their group's values; null keys and keys without a group go."""
    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(k, 0) for k in range(2, 1200)] + [(None, 1), (5000, 1)], "k long, v long")
    groups = spark.createDataFrame([(k, 5 if k == 1 else 1, -k) for k in range(1, 1200)], "k long, size long, w long")
    want = sorted([(1, i, -1) for i in range(5)] + [(k, 0, -k) for k in range(2, 1200)])
    for total in (None, 2000):
        assert sorted((x.k, x.v, x.w) for x in shared.joined_by_size(rows, groups, "k", "size", total).collect()) == want


def test_maybe_among(spark):
    rows = spark.range(200_000).select((F.col("id") * 7).alias("k"), F.col("id").alias("row"))
    keys = spark.range(5_000).select((F.col("id") * 70).alias("k"))
    got = shared.maybe_among(rows, keys, "k")
    assert got.columns == ["k", "row"] and got.join(keys, "k").count() == 5_000 and got.count() < 5_400
    assert shared.maybe_among(rows, keys.limit(0), "k").count() == 0


def test_near_dedup_leaves_texts_of_no_bucket_in_place(spark, docs):
    """Texts like no other are most of a corpus: they are not shuffled to find the few that are."""
    draw = random.Random(5)
    rows = [(i, " ".join(str(draw.getrandbits(40)) for _ in range(3000)), "en", "a") for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more", "en", "a") for i in range(3)]
    df = docs(rows, extra=False).repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store, bus = spark._jsc.sc().statusStore(), spark._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty(30_000)
        time.sleep(0.3)
        return sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))

    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = near_dedup.Work(spark, "texts-test").table(df, "docs")
        start = written()
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(df, 3, 85).collect()}
        moved = written() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i % 300 if i >= 300 else i for i in range(303)}
    assert 0 < moved < 0.25 * sum(len(r[1]) for r in rows)


def test_near_dedup_stage_ids(spark, docs):
    """Rows without an identifier, or sharing one, are decided each by its own text."""
    text = lambda s, n=60: " ".join(f"{s}{i}" for i in range(n))
    rows = [(None, text("a"), "en", "a"), (None, text("a") + " end", "en", "a"), (None, text("b"), "en", "a"), (5, text("c"), "en", "a"), (None, text("c") + " end", "en", "a"), (6, text("d"), "en", "a"), (6, text("c") + " tail", "en", "a")]
    got = near_dedup.stage(spark, docs(rows), "").select("doc_id", "text").collect()
    assert len(got) == 4 and sorted(x.text[:2] for x in got) == ["a0", "b0", "c0", "d0"]
    assert {(x.doc_id, x.text) for x in got if x.doc_id is not None} == {(5, text("c")), (6, text("d"))}


def test_banding_and_signature():
    for percent in (80, 85, 90):
        rows, bands = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS and bands <= near_dedup.MOST_BANDS
    a, b = near_dedup.permutations(400)
    x = shingles.mixed(np.arange(1000, dtype=np.uint64))
    one, two = near_dedup.signature(x[:800], a, b), near_dedup.signature(x[200:], a, b)
    assert abs((one == two).mean() - 0.6) < 0.06  # 600 of 1000


# quality


def quality_brute(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs):
    r = random.Random(3)
    rows = [(100 + i, " ".join(r.choice("ab#") for _ in range(r.randrange(40))) + "\nx\nx\n" * r.randrange(3), "en", None) for i in range(80)]
    rows += [tuple(x)[:4] for x in docs(extra=False).collect()]
    labels = spark.createDataFrame([(100, 1)], "doc_id long, quality int")
    got = quality.rate(docs(rows), labels).select("doc_id", "_m.*", "kept").collect()
    assert len(got) == len(rows)
    by_id = {x[0]: x[1] for x in rows}
    for g in got:
        n = quality_brute(by_id[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == n
        assert g.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and (g.kept or g.base_failed)
    assert quality.rate(docs([]), labels).count() == 0


def tail(k, n, risk):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log(1 - risk)) for i in range(k + 1))


def test_cutoffs_are_controlled(spark):
    """The admitted steps pass the exact test by hand and the next one doesn't; strata without enough labels have none."""
    r = random.Random(1)
    rows = [(i, " ".join(f"{r.randrange(10**6)}" + ("#" if i % 40 == 0 else "") for _ in range(20)), "en" if i < 2000 else "xx", "s") for i in range(2090)]
    df = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("lang", "stratum"))
    labels = spark.createDataFrame([(i, 1) for i in range(2090)], "doc_id long, quality int")
    found = quality.admitted(df, labels, risk=0.02, delta=0.05).collect()
    assert [f.stratum for f in found] == ["en"]
    good = [f._m for f in df.filter("stratum = 'en'").collect() if not f._m.base_failed]
    out = lambda m, step: any(quality.RULES[x][1] * (m[quality.RULES[x][0]] - c) > 0 for x, c in quality.PATH[: step + 1])
    k = [sum(out(m, s) for m in good) for s in range(len(quality.PATH))]
    passing = [tail(x, len(good), 0.02) <= 0.05 / 2 for x in k]
    assert found[0].step == passing.index(False) - 1 and found[0].k == k[found[0].step] and found[0].n == len(good)


def test_quality_rejects_by_cutoff_alone(spark, tmp_path):
    """query() and stage(): with a stratum's labels at hand, junk that passes the base rules goes and the good stay."""
    r = random.Random(2)
    text = lambda tail="": " ".join(f"word{r.randrange(10**5)}{tail}" for _ in range(30))
    rows = [(i, text(), lang, "s", "clash") for i in range(500) for lang in ["en" if i < 400 else "de"]]
    rows += [(1000 + i, text(" | #"), lang, "s", "clash") for i in range(6) for lang in ["en", "de"]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, stratum string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(500)] + [(1000, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.query(spark, str(tmp_path)).collect()
    assert len(got) == 512 and not any(g.base_failed for g in got)
    assert sum(not g.kept for g in got) == 6 and all(g.doc_id >= 1000 for g in got if not g.kept)  # German has 100 labels, too few
    kept = quality.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert len(kept) == 506 and sum(x.doc_id >= 1000 for x in kept) == 6 and {x.lang for x in kept if x.doc_id >= 1000} == {"de"}


# mixing


def test_mixing(spark, docs):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randrange(1, 60)), None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    got = [x.asDict() for x in mixing.mix(docs(rows)).collect()]
    again = [x.asDict() for x in mixing.mix(docs(rows).repartition(7)).collect()]
    key = lambda x: (x["doc_id"], x["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total = sum(x["size"] for x in got)
    assert abs(sum({x["source"]: x["target"] for x in got}.values()) - 1.5 * total) < 1e-6 * total
    for s in {x["source"] for x in got}:
        own = [x for x in got if x["source"] == s]
        assert own[0]["source_size"] == sum(x["size"] for x in own) and own[0]["target"] <= 2 * own[0]["source_size"] + 1e-9
        assert abs(sum(x["copies"] * x["size"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own) + 1 and max(x["copies"] for x in own) <= 2


def test_mixing_edges(spark, docs):
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs()).count() == docs().count()
    assert mixing.mix(docs([(1, None, None, None)])).first().copies == 0
    assert set(mixing.stage(spark, docs(), "").columns) == set(docs().columns)


def mix_brute(rows):
    """rows (doc_id, text, source) to the sorted identifiers that the mix emits, repeats included: systematic sampling, document by document."""
    weights, size = (3, 1, 2), {i: len(words(t)) for i, t, _ in rows}
    names = sorted({s for *_, s in rows})
    whole = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        level = (1.5 * sum(whole.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * whole[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * whole[s] for s in full}
        open_ -= full
    out = []
    for s in names:
        each = math.floor(target[s] / whole[s] * mixing.STEP) if whole[s] else 0
        at = int(hashlib.md5(f"mix|{s}".encode()).hexdigest()[:6], 16)
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (size[i], hashlib.md5(str(i).encode()).hexdigest())):
            out += [i] * ((at + each) // mixing.STEP - at // mixing.STEP)
            at += each
    return sorted(out)


def test_mixing_stage_ids(spark, docs):
    """The stage takes from each source what mix() says, whether identifiers are null or shared or not."""
    r = random.Random(8)
    rows = [(i if i % 3 else None if i % 2 else 9, f"t{i} " + " ".join("w" * r.randrange(1, 40)), None, r.choice(["a", "a", "b"])) for i in range(200)]
    want, got = Counter(), Counter()
    for x in mixing.mix(docs(rows)).collect():
        want[x.source] += x.copies * x.size
    out = mixing.stage(spark, docs(rows), "").collect()
    for x in out:
        got[x.source] += len(words(x.text))
    assert got == want and max(Counter(x.text for x in out).values()) <= 2


# BPE


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.public_file())
    r = random.Random(3)
    letters = list("abc'  \n\t.,12sß²éЖ中\x85\xa0\x1c😀") + ["<|endoftext|>", " the", "'s", "'ll"]
    rows = [tuple(x)[:4] for x in docs(extra=False).collect()] + [(500 + i, "".join(r.choice(letters) for _ in range(r.randrange(50))), None, None) for i in range(400)] + [(999, "ab" * 9000, None, None)]
    df = docs(rows)
    coded = bpe.encode(df, words=50)
    for x, row in zip(sorted(coded.collect(), key=lambda x: (repr(x.doc_id), x.n_tokens)), sorted(rows, key=lambda x: (repr(x[0]), len(tok.encode(x[1] or "").ids))), strict=True):
        ids = tok.encode(row[1] or "", add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {x.doc_id: x.text for x in bpe.decode(coded).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows)
    assert bpe.encode(docs([])).count() == 0


def test_automaton(tmp_path):
    v = bpe.Vocabulary.from_file(bpe.public_file())
    terms = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"a"]
    arcs, ends, _ = bpe.minimal_automaton(sorted(terms))
    assert sum(bool(a) for a in arcs) + 1 < len(set("".join(t.decode() for t in terms))) * 3  # suffixes are shared
    bpe.Lexicon.write(str(tmp_path / "lex"), terms, v)
    lex = bpe.Lexicon(str(tmp_path / "lex"))
    assert lex.find([*sorted(terms), b"ta", b"", b"tapsx"]).tolist() == [*range(len(terms)), -1, -1, -1]
    many = [b"hello", b"", b" world", bytes(range(40))]
    assert v.merge_many(many) == [v.merge(m) for m in many]
    assert v._merge_long([v.first[b] for b in b"internationalisation of things"]) == v.merge(b"internationalisation of things")


# LM


def test_lm_score(docs):
    df = docs()
    rows = [tuple(x)[:2] for x in df.collect()]
    got = lm_score.lm_score(df, depth=3, top=5).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(w.encode() for w in words(lower(t))), b""]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 for g in got)
    assert lm_score.lm_score(docs([])).count() == 0


def tree_costs(runs, counts, depth, low, pieces=1):
    """The cost of each run with the tree dealt into pieces of whole contexts, as the tasks do it."""
    order = np.argsort((runs >> 8) & ((1 << 8 * low) - 1), kind="stable")
    context = ((runs >> 8) & ((1 << 8 * low) - 1))[order]
    cuts = [0, *np.flatnonzero(np.diff(context)) + 1, len(order)][:: max(1, len(set(context.tolist())) // pieces)]
    cuts = [*cuts, len(order)] if cuts[-1] < len(order) else cuts
    parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    sums = {bit: [] for bit in range(8)}
    for p in parts:
        for bit, *columns in lm_score.upward(runs[p], counts[p], low, depth):
            sums[bit].append(columns)
    whole = {}
    for bit, found in sums.items():
        keys, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        add = lambda i: np.bincount(back, weights=np.concatenate([f[i] for f in found]), minlength=len(keys))
        whole[bit] = keys, add(1).astype(np.int64), add(2).astype(np.int64), add(3)
    top = lm_score.top_of(whole, low - 1)
    got = [lm_score.downward(runs[p], counts[p], low, depth, top) for p in parts]
    return dict(zip(np.concatenate([g[0] for g in got]).tolist(), np.concatenate([g[1] for g in got]).tolist(), strict=True))


@pytest.mark.parametrize("low", [1, 2])
def test_tree_is_a_distribution(low):
    """Against a context tree computed node by node, and sums to one in seen and unseen contexts."""
    runs, _ = lm_score.runs_of([lm_score.tokens(t) for t in ["ab abc", "abd ab", "abx aab"] * 3], 2)
    codes, n = np.unique(runs, return_counts=True)
    asked = np.array([(context << 8) + b for context in (0, 0x6162, 0x2061, 0x7878) for b in range(256)])
    both = np.unique(np.concatenate([codes, asked]))
    counts_of = np.zeros(len(both), np.int64)
    counts_of[np.searchsorted(both, codes)] = n
    costs = tree_costs(both, counts_of, 2, low, pieces=3)
    for context in (0, 0x6162, 0x2061, 0x7878):
        assert abs(sum(math.exp(costs[(context << 8) + b]) for b in range(256)) - 1) < 1e-6
    # runs that no training text holds change nothing for the others
    alone = tree_costs(codes, n, 2, low)
    assert all(abs(alone[c] - costs[c]) < 1e-9 for c in codes.tolist())
    counts = {}
    for code, k in zip(codes.tolist(), n.tolist(), strict=True):
        y, ctx = code & 255, [code >> 8 & 255, code >> 16 & 255]
        for d in range(3):
            for bit in range(8):
                node = counts.setdefault((tuple(ctx[:d]), bit, y >> (8 - bit)), [0, 0])
                node[y >> (7 - bit) & 1] += k
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, bit, q):
        own = kt(*counts[ctx, bit, q])
        if len(ctx) == 2:
            return own
        below = sum(weighted(k[0], bit, q) for k in counts if k[1:] == (bit, q) and len(k[0]) == len(ctx) + 1 and k[0][: len(ctx)] == ctx)
        return math.log(0.5) + np.logaddexp(own, below)

    for code in codes.tolist():
        y, ctx, cost = code & 255, (code >> 8 & 255, code >> 16 & 255), 0.0
        for bit in range(8):
            q, p, rest = y >> (8 - bit), 0.0, 1.0
            for d in range(3):
                a, b = counts[ctx[:d], bit, q]
                stay = 1.0 if d == 2 else math.exp(math.log(0.5) + kt(a, b) - weighted(ctx[:d], bit, q))
                p, rest = p + rest * stay * (b + 0.5) / (a + b + 1), rest * (1 - stay)
            cost += math.log(p if y >> (7 - bit) & 1 else 1 - p)
        assert abs(costs[code] - cost) < 1e-4


def test_words_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    split = [lm_score.tokens(t) for t in ["a b a c", "", "x y x", "b b", "q"]]
    known = {b"a": 0.1, b"b": 0.7, b"x": 1.3, lm_score.END: 2.0}
    n_known, base, rare = lm_score.word_sums(split, Counted(known))
    assert Counted.asked <= sum(len(set(w)) for w in split) + len(split) + 1
    assert n_known == [sum(x in known for x in w) + 1 for w in split]
    assert base == [math.fsum(k * known[x] for x, k in Counter(w).items() if x in known) + 2.0 for w in split]
    assert rare.to_pylist() == [[{"word": x, "k": k} for x, k in Counter(w).items() if x not in known] for w in split]
    assert lm_score.word_sums(split, {})[0] == [0] * len(split)


def test_words_of_all_texts_are_looked_up_together():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    r = random.Random(4)
    split = [[r.choice([b"a", b"b", b"c", b"d", b"\x00", "ж".encode()]) for _ in range(r.randrange(9))] for _ in range(60)]
    known = {b"a": 0.25, b"b": 0.5, b"\x00": 1.25}
    for common in (Counted(known), Counted(known | {lm_score.END: 2.0}), {}):
        Counted.asked, end = 0, lm_score.END in common
        n_known, base, rare = lm_score.word_sums(split, common)
        assert Counted.asked <= len({x for w in split for x in w}) + 1
        assert n_known == [sum(x in common for x in w) + end for w in split]
        assert base == [sum(common[x] for x in w if x in common) + 2.0 * end for w in split]
        assert [{x["word"]: x["k"] for x in row} for row in rare.to_pylist()] == [dict(Counter(x for x in w if x not in common)) for w in split]
    n_known, base, rare = lm_score.word_sums([[]], {})
    assert (n_known, base, rare.to_pylist()) == ([0], [0.0], [[]])


def test_words_are_tallied_in_arrays():
    r = random.Random(5)
    words_ = [[r.choice([b"a", b"bb", b"", b"\x00", "ж".encode()]) for _ in range(k)] for k in (7, 0, 30, 1)]
    arrays = [pa.array(w, pa.binary()) for w in words_]
    tally = None
    for some in (arrays[:2], [], arrays[2:]):
        tally = lm_score.tallied(some, tally)
    assert dict(zip(*tally.to_pydict().values(), strict=True)) == Counter(x for w in words_ for x in w) and tally.num_rows == 5
    assert lm_score.tallied([], None).num_rows == 0


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_runs_end_at_each_byte(depth):
    texts = ["", "a", "Ab  c", "ж中 x" * 5, "\x00\xff", "internationalisation"]
    split = [lm_score.tokens(t) for t in texts]
    codes, n = lm_score.runs_of(split, depth)
    want = []
    for w in split:
        raw = bytes(depth) + b"".join(x + b" " for x in w) + b"\n"
        want += [int.from_bytes(raw[i - depth : i + 1], "big") for i in range(depth, len(raw))]
    assert codes.tolist() == want and n.tolist() == [sum(len(x) + 1 for x in w) + 1 for w in split]


def test_rare_words_are_not_sorted(docs):
    """Rare words of texts meet their counts in hash tables of the distinct words, so that only the texts' keys are sorted."""
    plan = lm_score.lm_score(docs(), depth=2, top=2)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [word" in plan and "Sort [word" not in plan


def test_parts_do_not_change_scores(docs):
    """Scores are the same however texts are dealt into parts, and however few labelled texts there are."""
    df = docs()
    key = lambda r: (str(r.doc_id), r.held_out, r.n_tokens, round(r.score, 3))
    one = sorted(map(key, lm_score.lm_score(df, depth=4, top=5).collect()))
    assert one == sorted(map(key, lm_score.lm_score(df.repartition(5), depth=4, top=10**6, part_size=40, top_runs=30).collect()))
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    held = lm_score.lm_score(docs([(i, "ab c", "en", "a") for i in only])).collect()
    assert all(abs(r.score + 6 * math.log10(256)) < 1e-4 and r.n_known == 0 for r in held)


# licenses


def test_license_scan(spark, docs):
    r = random.Random(4)
    vocabulary = sorted({w.decode() for _, t in license_scan.NOTICES for w in license_scan.words_of(t)})
    rows = [tuple(x)[:4] for x in docs(extra=False).collect()]
    rows += [(300 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(60))) + " " + r.choice(license_scan.NOTICES)[1] + "," + " zz" * r.randrange(9), None, None) for i in range(60)]
    rows += [(500, "under the MIT license; under the mit-license cc by-nc", None, None)]
    got = license_scan.license_scan(docs(rows)).collect()
    texts = Counter((i, t) for i, t, *_ in rows)
    assert len(got) == len(rows) and texts
    by_id = {i: t for i, t, *_ in rows}
    for g in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(by_id[g.doc_id]))
        base = [(x, i) for x, p in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want = {x for x, _ in base}
        for label, text in license_scan.NOTICES:
            n = license_scan.Notice(label, text, {}, license_scan.THRESHOLD)
            length, own = min(n.length, len(w)), {x.decode() for x in n.order}
            sets = {(x, frozenset(y.decode() for y in license_scan.words_of(t))) for x, t in license_scan.NOTICES}
            sisters = [o for x, o in sets if x != label and len(own & o) >= n.need]
            names = lambda b: all(own - o <= b if own - o else not o - own <= b for o in sisters if o != own)  # noqa: E731, B023
            if len(w) >= n.need and any(len(own & b) >= n.need and names(b) for i in range(len(w) - length + 1) for b in [set(w[i : i + length])]):
                want.add(label)
        assert (g.n_words, g.n_base, g.base_labels, g.labels) == (len(w), len(base), ",".join(sorted({x for x, _ in base})), ",".join(sorted(want)))
        assert (g.first_word, g.last_word) == ((min(i for _, i in base), max(i for _, i in base)) if base else (None, None)) and 0 <= g.score <= 1
    assert license_scan.license_scan(docs([])).count() == 0


def test_license_matches_are_all_found():
    """Each copy of a notice in a text, and exactly the blocks that qualify by brute force."""
    r = random.Random(6)
    for label, text in license_scan.NOTICES[:6]:
        notice = license_scan.Notice(label, text, {}, license_scan.THRESHOLD)
        own = license_scan.words_of(text)
        w = [b"aa"] * 60 + own + [b"bb"] * 70 + own + [r.choice([*own, b"cc"]) for _ in range(90)] + [b"dd"] * 50 + own[1:]
        places = {}
        for i, x in enumerate(w):
            if x in notice.order:
                places.setdefault(x, []).append(i)
        size = [len(set(notice.order).intersection(w[i : i + notice.length])) for i in range(len(w) - notice.length + 1)]
        good = [i for i, k in enumerate(size) if k >= notice.need]
        found = notice.matches(places, len(w))
        assert len(found) >= 2
        assert [i for _, a, b in found for i in range(a, b - notice.length + 2)] == good
        assert all(k == max(size[a : b - notice.length + 2]) for k, a, b in found)


@pytest.mark.parametrize(("text", "labels"), [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or later", "gpl-2"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or later", "gpl-3"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "lgpl"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "agpl-3"),
])
def test_sister_licenses_have_one_label_each(spark, text, labels):
    rows = [(1, text, None, None), (2, f"Notes before. {text}. Notes after it, and many more words of no license at all.", None, None)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert [r.labels for r in got] == [labels, labels]


def test_license_long_notices_and_places():
    """A whole license among other words is one match of each of its notices; base places are counted along the text."""
    label, text = max(license_scan.NOTICES, key=lambda x: len(x[1]))
    w = license_scan.words_of("some words before it " * 40 + text + " and some words after it" * 40)
    notice = license_scan.Notice(label, text, {}, license_scan.THRESHOLD)
    places = {}
    for i, x in enumerate(w):
        places.setdefault(x, []).append(i)
    met, first, last = notice.matches(places, len(w))[0]
    assert met == len(notice.order) and first <= 160 and last >= 160 + len(license_scan.words_of(text)) - 1
    many = license_scan.words_of("cc by nc and cc by nc by nc " * 20_000)
    got = license_scan.base_places(many)
    assert len(got) == 40_000 and [p for _, p in got] == [i for i in range(len(many) - 2) if many[i : i + 3] == [b"cc", b"by", b"nc"]]


# PII


@pytest.mark.parametrize("text", ["f3" * 500_000, "a@" * 500_000, "a.b-c_" * 170_000 + "@", "x@" + "a." * 500_000, "1.2." * 250_000, "+1-555-" * 150_000, "A" * 300_000 + "@b.cd" + "e" * 700_000])
def test_pii_is_linear_in_any_word(spark, text):
    began = time.monotonic()
    got = pii.pseudonymise(spark.createDataFrame([(1, text + " 7 a.b@c.de")], "doc_id long, text string"), "k").first()
    assert got._kinds[-1] == "email" and len(got.text) == len(text) + 11 and time.monotonic() - began < 60


def test_pii_mail_addresses(docs):
    texts = {1: "a@b.co1x@y.org", 2: "x@y", 3: "a@b.c1", 4: "m@n.com.", 5: "a@b.com%c@d.net,e@f.info"}
    got = {r.doc_id: len(r._kinds) for r in pii.pseudonymise(docs([(i, t, "", "") for i, t in texts.items()]), "k").collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 1, 5: 3}


def test_pii(docs):
    text = "Call +1 (443) 555-5793 or a.b-c9@mail2.example.com on 2024-02-29, 31/12/1999, 30.02.2020; 4111 1111 1111 1111, 4929348385146306, 4111111111111112; 10.0.0.255 999.1.1.1; 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde 078-05-1120"
    rows = [(1, text, "", ""), (2, "4111111111111111 +1 (443) 555-5793", "", ""), (3, None, "", ""), (4, "", "", ""), (5, "plain", "", "")]
    hidden = pii.pseudonymise(docs(rows), "k")
    got = {r.doc_id: r for r in hidden.collect()}
    assert got[1]._kinds == ["phone", "email", "date", "date", "card", "card", "ip", "secret", "ssn"]
    for kept in ("30.02.2020", "4111111111111112", "999.1.1.1", "@mail2.example.com"):
        assert kept in got[1].text
    for gone in ("555-5793", "a.b-c9", "2024-02-29", "4111 1111 1111 1111", "10.0.0.255", "2abc3ff2", "078-05-1120"):
        assert gone not in got[1].text
    shape = lambda t: re.sub("[a-f0-9]", "9", t)
    assert len(shape(got[1].text)) <= len(text) + 12 and got[3].text is None and got[4].text == "" and got[5].text == "plain"
    one = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1].text).group().replace(" ", "")
    assert one == got[2].text[:16] and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(one)) % 10 == 0
    back = {r.doc_id: r.text for r in pii.pseudonymise(hidden.drop("_kinds"), "k", back=True).collect()}
    assert back == {i: t for i, t, *_ in rows}
    assert pii.pseudonymise(docs([]), "k").count() == 0


def feistel(value, key, kind, alphabets):
    """The permutation in plain Python."""
    half = len(value) // 2
    a, b = value[:half], value[half:]
    for r in range(pii.ROUNDS):
        seed = f"{key}|{kind}|{r}|{len(value)}|{b}"
        stream = "".join(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest() for i in range(max(len(a) - 1, 0) // 16 + 1))
        out = ""
        for i, c in enumerate(a):
            alphabet = next((x for x in alphabets if c in x), None)
            out += alphabet[(alphabet.index(c) + int(stream[4 * i : 4 * i + 4], 16)) % len(alphabet)] if alphabet else c
        a, b = b, out
    return a + b


def luhn_sum(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))


def pseudonym_brute(value, key):
    from datetime import date, timedelta

    kind = next(k for k, p in pii.KINDS if re.fullmatch(p, value))
    digits = re.sub("[^0-9]", "", value)
    refill = lambda d: re.sub("[0-9]", lambda m, it=iter(d): next(it), value)
    if kind == "email":
        name, _, rest = value.partition("@")
        return feistel(name, key, kind, pii.PLAIN) + "@" + rest
    if kind == "secret":
        out = feistel(value.lower(), key, kind, pii.HEX)
        return out if re.search("[a-f]", value) else out.upper()
    if kind == "phone":
        keep = max(len(digits) - 10, 0)
        return refill(digits[:keep] + feistel(digits[keep:], key, kind, pii.PLAIN))
    if kind == "ssn":
        return refill(feistel(digits, key, kind, pii.PLAIN))
    if kind == "card":
        if luhn_sum(digits) % 10:
            return value
        image = feistel(digits[:-1], key, kind, pii.PLAIN)
        return refill(image + str(-luhn_sum(image + "0") % 10))
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255:
            return value
        packed = feistel("".join(f"{x:02x}" for x in parts), key, kind, pii.HEX)
        return ".".join(str(int(packed[i : i + 2], 16)) for i in range(0, 8, 2))
    form = "%Y-%m-%d" if "-" in value else "%d/%m/%Y" if "/" in value else "%d.%m.%Y"
    try:
        y, m, d = (int(x) for x in (re.split("-", value) if "-" in value else re.split("[/.]", value)[::-1]))
        day = (date(y, m, d) - date(1900, 1, 1)).days
    except ValueError:
        return value
    if not 0 <= day < pii.DAYS:
        return value
    day = int(feistel(f"{day:05d}", key, kind, pii.PLAIN))
    while day >= pii.DAYS:
        day = int(feistel(f"{day:05d}", key, kind, pii.PLAIN))
    return (date(1900, 1, 1) + timedelta(day)).strftime(form)


def test_pii_by_brute_force(docs):
    """Whole texts of random values of every kind, among junk, against plain Python."""
    r = random.Random(12)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        body = r.choice(["4", "5", "37"]) + d(r.choice([11, 13, 14]))
        whole = body + str(-luhn_sum(body + "0") % 10)
        return " ".join(whole[i : i + 4] for i in range(0, 16, 4)) if len(whole) == 16 and r.random() < 0.5 else whole

    makers = [
        lambda: f"{r.choice(['ann', 'B.Lee-9', 'x'])}{d(r.randrange(3))}@{r.choice(['a.org', 'mail.example.co.uk'])}", lambda: ".".join(str(r.randrange(300)) for _ in range(4)), card, lambda: d(16),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(32, 65))), lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(40)), lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"{r.randrange(1890, 2110)}-{r.randrange(1, 14):02d}-{r.randrange(1, 32):02d}", lambda: f"{r.randrange(1, 32):02d}/{r.randrange(1, 13):02d}/{r.randrange(1900, 2100)}", lambda: f"{r.randrange(1, 32):02d}.{r.randrange(1, 13):02d}.1999",
        lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"+{d(11)}", lambda: "plain words", lambda: d(5), lambda: "@",
    ]
    rows = [(i, r.choice([" ", "; ", "\n"]).join(r.choice(makers)() for _ in range(12)), "", "") for i in range(120)]
    got = {x.doc_id: x.text for x in pii.pseudonymise(docs(rows), "some key").collect()}
    for i, text, *_ in rows:
        assert got[i] == re.sub(pii.PATTERN, lambda m: pseudonym_brute(m.group(), "some key"), text)


def test_pii_key_and_names(spark, docs):
    """No key, no pseudonyms; other keys, other pseudonyms; columns of any name stay."""
    with pytest.raises(ValueError):
        pii.pseudonymise(docs())
    spark.conf.set(pii.KEY_SETTING, "one")
    try:
        rows = docs([(1, "4111111111111111", "en", "a")])
        for name in CLASHES:
            rows = rows.withColumn(name, F.lit("clash"))
        one, other = pii.pseudonymise(rows).first(), pii.pseudonymise(rows, "two").first()
        assert one.text == pseudonym_brute("4111111111111111", "one") != other.text
        assert one["_p"] == one["row"] == "clash" and one["_kinds"] == ["card"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)
