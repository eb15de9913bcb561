import random
import re

import pytest

from quarrygraph.llm import mixing as M
from quarrygraph.llm import near as N

WORD = re.compile(r"[A-Za-z0-9_]+")


def brute(rows, threshold, least):
    sets = {i: set(WORD.findall(t)) for i, t in rows if t}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(6)
    rows, n = [], 0
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(50)] + "if for int return the".split()
        for _ in range(r.randrange(1, 4)):
            words = list(base)
            for _ in range(r.randrange(0, 12)):
                words[r.randrange(50)] = f"w{r.randrange(3000)}"
            r.shuffle(words)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n + k, rows[0][1]) for k in range(5)] + [(n + 10, None), (n + 11, ""), (n + 12, "too few words"), (n + 13, rows[1][1] + "\r\n")]
    return rows


def test_pairs_against_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "id long, source string, rid int, words string").repartition(4)
    members, links = N.similar_pairs(df)
    got = {tuple(r) for r in N.all_pairs(members, links).collect()}
    want = brute(texts, 0.7, 30)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 30


def test_groups(spark, texts):
    df = spark.createDataFrame(texts, "id long, source string")
    rows = {r["rid"]: r["class_id"] for r in N.groups(*N.similar_pairs(df)).collect()}
    assert len(rows) == sum(1 for _, t in texts if t and len(set(WORD.findall(t))) >= 30)
    for a, b in brute(texts, 0.75, 30):
        assert rows[a] == rows[b]


def test_empty_tables(spark):
    members, links = N.similar_pairs(spark.createDataFrame([], "id long, source string"))
    assert N.all_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0


def test_water_filling():
    got = M.water_fill(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 20, "b": 1000, "c": 1000})
    assert got["a"] == 20 and got["b"] == pytest.approx(48) and got["c"] == pytest.approx(32)
    assert M.water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert M.water_fill(100, {"a": 1.0, "b": 0.0}, {"a": 0}) == {"a": 0.0, "b": 0.0}
    assert sum(M.water_fill(60, {"a": 2, "b": 2}, {"a": 99, "b": 99}).values()) == pytest.approx(60)


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, "big" if i % 3 else "small", r.randrange(5, 40)) for i in range(3000)] + [(9000, None, 50), (9001, "big", 0), (9002, "small", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    plan = [("m", "big", 0.4, 2, 0.5), ("m", "small", 0.5, 3, 0.5), ("m", "absent", 0.1, 3, 0.5), ("huge", "small", 1.0, 2, 9.0)]
    targets = spark.createDataFrame(plan, "mix string, source string, target_share double, max_repeats int, size_factor double")
    rows, shares = M.mix(sized, targets)
    s = {(x["mix"], x["source"]): x for x in shares.collect()}
    total = sum(n for *_, n in docs)
    assert s["m", "absent"]["actual_tokens"] == 0
    assert s["m", "big"]["actual_share"] == pytest.approx(4 / 9, abs=0.01) and s["m", "small"]["actual_share"] == pytest.approx(5 / 9, abs=0.01)
    assert s["m", "big"]["actual_tokens"] + s["m", "small"]["actual_tokens"] == pytest.approx(0.5 * total, rel=0.01)
    small = sum(n for _, x, n in docs if x == "small")
    assert s["huge", "small"]["actual_tokens"] == 2 * small
    copies = rows.collect()
    assert max(c["copies"] for c in copies if c["mix"] == "m") <= 3 and len({(c["mix"], c["doc_id"]) for c in copies}) == len(copies)
    again = M.mix(sized.repartition(5), targets)[0]
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in copies}  # the same seed gives the same texts


def test_mix_of_nothing(spark):
    rows, shares = M.mix(spark.createDataFrame([], "doc_id long, source string, n_tokens long"), spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], "mix string, source string, target_share double, max_repeats int, size_factor double"))
    assert rows.count() == 0 and shares.first()["actual_share"] == 0.0


@pytest.mark.parametrize("hot", [2, 5, 128])
def test_hot_keys_lose_no_pair(spark, texts, hot):
    # beside the texts, a crowd that shares 40 of 60 words, too few to be similar, but enough for common keys
    r = random.Random(8)
    base = [f"b{k}" for k in range(40)]
    crowd = [(1000 + i, " ".join(base + [f"c{r.randrange(5000)}" for _ in range(20)])) for i in range(60)]
    df = spark.createDataFrame(texts + crowd, "id long, source string")
    got = {tuple(x) for x in N.all_pairs(*N.similar_pairs(df, hot=hot)).collect()}
    want = brute(texts + crowd, 0.7, 30)
    assert got <= want and len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_meetings_against_brute_force(spark, hot):
    r = random.Random(2)
    rows = [(i, k) for i in range(80) for k in r.sample(range(40), 3)] + [(i, 99) for i in range(50)]
    table = spark.createDataFrame(rows, "rep long, key long").repartition(3)
    by: dict = {}
    for i, k in rows:
        by.setdefault(k, []).append(i)
    found = N.meet(table, hot)
    assert {(x["ra"], x["rb"]) for x in found.filter("rb IS NOT NULL").collect()} == {(a, b) for v in by.values() if len(v) <= hot for a in v for b in v if a < b}
    crowd = found.filter("rb IS NULL").selectExpr("ra AS rep", "key")
    assert {tuple(x) for x in crowd.collect()} == {(i, k) for k, v in by.items() if len(v) > hot for i in v}
    assert {tuple(x) for x in N._blocks(crowd, hot).collect()} == {(a, b) for v in by.values() if len(v) > hot for a in v for b in v if a < b}


def test_ids_may_be_texts(spark, texts):
    rows = [(f"id{i:05d}", t) for i, t in texts]
    df = spark.createDataFrame(rows, "id string, source string")
    members, links = N.similar_pairs(df, hot=2)
    want = {(f"id{a:05d}", f"id{b:05d}") for a, b in brute(texts, 0.7, 30)}
    got = {tuple(r) for r in N.all_pairs(members, links).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert N.groups(members, links).count() == members.count()
