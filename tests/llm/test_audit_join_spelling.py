"""Source audit, n-gram join and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("size", "node", "g", "c", "z", "n", "d", "digest", "root", "term", "count", "p", "q", "copies",
         "word", "token", "id", "run", "near", "kept")


def frame(spark, rows):
    """With further columns that have the names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in NAMES:
        df = df.withColumn(name, F.lit("own"))
    return df


ODD = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0),
       (3, " \t\n ", "en", "s", 4), (4, "word " * 5000, "en", "s", 25000), (4, "word " * 5000, "en", "s", 25000),
       (5, "Ünï cödé 中文字 😀 x", "de", "t", 18), (6, "x" * 300_000, "en", "s", 300_000), (None, None, None, None, None),
       (7, "A b C d e F", None, "s", 11), (8, "a b c", "en", "t", 5), (9, "a B c", "en", None, 5)]


# --- n-gram join

def linked_groups(rows, k, percent):
    ids = {}
    sets = []
    for r in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), ids.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def joined(df, **more):
    from citeweave.llm.ngram_join import ngram_join
    return Counter(tuple(r) for r in ngram_join(df, **more).select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, times, insert=False):
    w = list(words)
    for _ in range(times):
        at = rng.randrange(len(w))
        if insert and rng.random() < 0.5:
            w.insert(at, f"new{rng.randrange(30)}")
        else:
            w[at] = f"new{rng.randrange(30)}"
    return w


@pytest.fixture(scope="module")
def copies():
    """Two large groups of near copies that share half of their words, a line that
    most texts hold, exact copies, and texts of a few words."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line, common = fresh(12), fresh(40)
    one, two = common + fresh(45), common + fresh(40)
    rows = []
    for _ in range(90):
        rows.append(edited(rng, one, rng.choice([0, 1, 1, 2, 2, 3, 4]), insert=True))
        rows.append(edited(rng, two, rng.choice([0, 1, 2, 2, 3])))
    for _ in range(60):
        rows.append(fresh(rng.choice([2, 20, 60])) + line + fresh(rng.choice([0, 1, 30])))
    for _ in range(20):
        rows.append(edited(rng, line * 3, rng.choice([0, 1, 2])))
    rows += [rows[3]] * 5 + [line] * 3 + [line + [x] for x in "abc"] + [["a"], ["A"], ["a", "b"], ["b", "a"]]
    rng.shuffle(rows)
    return [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]


@pytest.mark.parametrize("cold,rounds", [(16, 3), (2, 1), (3, 3)])
def test_join_equals_all_pairs(spark, copies, monkeypatch, cold, rounds):
    from citeweave.llm import ngram_join
    monkeypatch.setattr(ngram_join, "COLD", cold)
    monkeypatch.setattr(ngram_join, "DEVIANT", cold)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    assert joined(frame(spark, copies)) == linked_groups(copies, 5, 80)


def test_join_other_sizes(spark, copies):
    part = copies[:150]
    assert joined(frame(spark, part), shingle=3, percent=60) == linked_groups(part, 3, 60)


def test_join_odd_rows(spark):
    assert joined(frame(spark, ODD)) == linked_groups(ODD, 5, 80)
    assert not joined(frame(spark, []))


def test_join_repeated_ids(spark):
    """A doc_id with several texts stands for each of them."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "s", 0), (1, "other " + base[5:], "en", "s", 0), (1, "x y z", "en", "s", 0),
            (5, base + " end", "en", "s", 0), (None, "x y z", "en", "s", 0), (7, "x y z", "en", "s", 0)]
    assert joined(frame(spark, rows)) == linked_groups(rows, 5, 80)


# --- source audit

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= least]

        def shares(names):
            n = {t: sum(counts[lang, s][t] for s in names) for t in kept}
            total = sum(n.values())
            return {t: 1 + 1_000_000_000 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p, q = {s: shares([s]) for s in sources}, shares(sources)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            own = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", own, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def found_by_audit(df, **more):
    from citeweave.llm.source_audit import audit
    rows = audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_audit_equals_dense_sums(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["Éa", "bb", "CC", "d1e", "-", "中文", f"t{rng.randrange(9)}x", f"r{rng.randrange(99)}"])  # noqa: E731,E501
                            for _ in range(rng.choice([0, 5, 60])))
    rows = [(i, text(), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ſ", None]), 0) for i in range(120)]
    rows += [rows[0]] * 30 + [(500 + i, rows[1][1], "en", f"s{i % 5}", 0) for i in range(20)]
    rows += [(900, "??", "fr", "only", 0), (901, "", "it", "a", 0), (902, "1", "it", "b", 0)]
    assert found_by_audit(frame(spark, rows), least_docs=10, top=3) == audited(rows, 10, 3)


def test_audit_odd_rows_and_flush(spark, monkeypatch):
    assert found_by_audit(frame(spark, ODD), least_docs=1, top=10) == audited(ODD, 1, 10)
    assert not found_by_audit(frame(spark, []))


def test_task_sums_are_sent_on_when_full(monkeypatch):
    import pyarrow as pa
    from citeweave.llm import source_audit
    monkeypatch.setattr(source_audit, "HELD", 3)
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": "a b c d a", "copies": [{"source": "s", "n": 2}]},
                                        {"lang": "en", "text": "a B", "copies": [{"source": "s", "n": 1}]}])
    parts = list(source_audit._count_terms([batch]))
    total = Counter()
    for p in parts:
        for r in p.to_pylist():
            total[r["term"]] += r["count"]
    assert len(parts) == 2 and total == {b"a": 5, b"b": 3, b"c": 2, b"d": 2}


# --- spelling variants

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(counts):
    near_of = {w: [u for u in counts if near(w, u)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near_of[w], key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near_of[w]), counts[form[w]] if form[w] else None))
    return out


def counted(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("frequent", [0, 3, 64, 10_000])
def test_variants_equal_all_pairs(spark, monkeypatch, frequent):
    from citeweave.llm import spelling
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    rng = random.Random(frequent)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8, 9]))): rng.choice([5, 6, 30, 200, 1500])
             for _ in range(500)}
    words |= {"aaaaaa": 5, "aaaaaaa": 5000, "aaaaaaaa": 26, "bababa": 5, "ababab": 5, "bababab": 25}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.variant_groups(df).select(*COLUMNS).collect()
    assert len(found) == len(words) and {tuple(r) for r in found} == variants(words)


def test_variants_of_texts(spark):
    from citeweave.llm.spelling import runs_of, variant_groups, vocabulary
    rng = random.Random(8)
    stems = ["Grafenau", "grafenäu", "GRAFENAUS", "château", "chateau", "kolobrzeg", "×kolobrzeg", "short"]
    rows = [(i if i % 50 else None, " ".join(rng.choices(stems, [9, 1, 1, 9, 1, 9, 1, 3], k=40)) + "1x_y", None, None, 0)
            for i in range(400)] + ODD
    found = variant_groups(vocabulary(runs_of(frame(spark, rows), thinned=199))).select(*COLUMNS).collect()
    assert len(found) == len(set(found)) > 5 and {tuple(r) for r in found} == variants(counted(rows))
    empty = variant_groups(vocabulary(runs_of(frame(spark, []), thinned=199)))
    assert empty.select(*COLUMNS).collect() == []
