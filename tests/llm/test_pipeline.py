"""The pipeline against a plain Python version of its stages, and the registered queries against their SQL."""

import hashlib
import math
import os
import re

import pytest
import xxhash

DATA = "/root/testdata/sf0.001"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[^\x20\x09-\x0D]+"
with_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def failed(text):
    w = re.findall(BLANK, text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    repeat = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def plain_quality(docs):
    marks = [(d["source"], failed(d["text"])) for d in docs]
    hosts = {h: [f for g, f in marks if g == h] for h, _ in marks}
    n, mean = len(marks), sum(f for _, f in marks) / max(1, len(marks))
    between = max(1e-9, sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in hosts.values()) / max(1, n) - mean * (1 - mean) * len(hosts) / max(1, n))
    strength = min(1000, max(1, mean * (1 - mean) / between - 1))
    bad = {h for h, x in hosts.items() if (sum(x) + strength * mean) / (len(x) + strength) >= mean + 0.25}
    return [d for d, (h, f) in zip(docs, marks) if not f and h not in bad]


def plain_near(docs):
    """Links of similarity 0.8 within 14 bits; the smallest doc_id of each component (null last)."""
    sets, prints = [], []
    for d in docs:
        w = re.findall(BLANK, lower(d["text"]))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))] if w else []
        sets.append(frozenset(h))
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or (prints[i] ^ prints[j]).bit_count() <= 14 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return [min(g, key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0)) for g in groups.values()]


def plain_clean(docs, items):
    windows = set()
    for item in items:
        v = re.findall(ALNUM, lower(item))
        windows.update(tuple(v[a : a + 10]) for a in range(max(1, len(v) - 9)) if v)
    sizes = {len(w) for w in windows}

    def holds(text):
        w = re.findall(ALNUM, lower(text))
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return [d for d in docs if not holds(d["text"])]


def plain_mix(docs):
    sizes = [len(re.findall(BLANK, d["text"] or "")) for d in docs]
    order = sorted({d["source"] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for d, n in zip(docs, sizes) if d["source"] == s) for s in order}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, goal = 1.5 * sum(sizes), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        goal.update({s: 2 * total[s] if full else level * weight[s] for s in full or open_})
        left -= sum(goal[s] for s in full)
        open_ = open_ - full if full else set()
    taken, place = [], {}
    for d, n in sorted(zip(docs, sizes), key=lambda x: (x[1], hashlib.md5(f"20240229|{'' if x[0]['doc_id'] is None else x[0]['doc_id']}|{x[1]}".encode()).hexdigest()[:16], x[0]["doc_id"] is not None, x[0]["doc_id"] or 0)):
        s = d["source"]
        k, rate = place.get(s, 0), goal[s] / total[s] if total[s] else 0.0
        place[s] = k + 1
        start = int(hashlib.md5(f"20240229|{'n' if s is None else 's' + s}".encode()).hexdigest()[:7], 16) / 2**28
        taken += [d] * (math.floor((k + 1) * rate + start) - math.floor(k * rate + start))
    return taken


def ids(rows):
    return sorted((str(r["doc_id"]) for r in rows))


@with_data
def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = {"quality_rules": plain_quality, "near_duplicates": plain_near, "decontamination": lambda d: plain_clean(d, items), "mixture": plain_mix}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "mixture"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA).cache()
        old, new = [[r.asDict() for r in t.collect()] for t in (before, after)]
        assert after.columns == columns + ["mix_copy"] * (name == "mixture")
        if name in plain:
            assert ids(new) == ids(plain[name](old)), name
        else:
            was = {r["doc_id"]: r["text"] for r in old}
            assert ids(new) == ids(old) and all(r["n_chars"] == len(r["text"]) for r in new)
            personal = re.compile(r"[\w.+-]+@mail\d|password=\S+|\b\d{3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b\d{16}\b|\b[0-9a-f]{40}\b|\(\d{3}\) 555-\d{4}")
            found = [(m, r["text"]) for r in new for m in personal.findall(was[r["doc_id"]])]
            assert found and not any(m in text for m, text in found)
            assert all(was[r["doc_id"]] == r["text"] for r in new if not re.search(r"[0-9@=:]|M[rs]|Dr|Prof", was[r["doc_id"]]))
        before = after


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties, empty and very long texts, clashing names, and an empty table."""
    import corpus_pipeline

    def words(k, n=80):
        return " ".join(f"k{k}n{i}" for i in range(n))

    leak = " ".join(f"bench{i}" for i in range(12))
    table = [
        (1, words(1), "s0"), (2, words(1), "s0"), (None, words(2), None), (None, words(2), None), (None, words(3), "s1"), (3, None, "s0"), (4, "", "s0"), (5, words(5) + " " + leak, "s1"),
        (6, words(6) + " mail bob.1@x.example.com", "s0"), (7, words(7, 60_000), "s1"), (7, words(8), "s1"), (8, words(9), "s2"), (8, words(9), "s2"), (9, "x " * 300, "s1"), (10, words(1) + " more", "s1"),
    ]
    rows = [(i, t, "en", s, len(t or ""), "h", 1, 2.0, "k") for i, t, s in table]
    schema = "doc_id long, text string, lang string, source string, n_chars long, host string, mix_copy int, size double, node string"
    for name, own in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(own, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([("b", leak), (None, "x"), ("c", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns == [*schema.replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", "), "mix_copy_2"]
    docs = [dict(doc_id=i, text=t, source=s) for i, t, s in table]
    kept = plain_clean(plain_near(plain_quality(docs)), [leak])
    assert ids(kept) == sorted(["1", "None", "None", "6", "7", "7", "8"])
    got = [r.asDict() for r in out.collect()]
    want = plain_mix([d | {"text": re.sub("bob.*", "x", d["text"])} for d in kept])
    assert ids(got) == ids(want) and not any("bob.1" in r["text"] for r in got)
    assert {r["text"] for r in got if r["doc_id"] != 6} <= {t for _, t, _ in table}
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == out.columns


@with_data
def test_queries_against_sql(spark):
    import duckdb

    from opalgrid.llm import queries

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}{'/*.parquet' if os.path.isdir(f'{DATA}/{f}') else ''}'")
    for name, sql in queries.oracle_sql().items():
        rows = queries.queries()[name](spark, DATA)
        made = con.execute(sql)
        names = [d[0] for d in made.description]
        assert sorted(names) == sorted(rows.columns)
        assert sorted(map(str, map(tuple, rows.select(*names).collect()))) == sorted(map(str, made.fetchall())), name
