"""Every operator against a brute-force version, and on odd rows."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def words_of(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}x{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact and near copies and a passage that texts share."""
    rng = random.Random(5)
    texts = [" ".join(words_of(rng, rng.choice([3, 30, 90, 200]))) for _ in range(60)]
    passage = " ".join(words_of(rng, 60))
    for i in (5, 17, 40):
        texts[i] = " ".join(words_of(rng, 30)) + " " + passage + " " + " ".join(words_of(rng, 40))
    base = words_of(rng, 150)
    for i in range(20, 28):
        w = list(base)
        w[rng.randrange(150)] = f"edit{i}"
        texts[i] = " ".join(w)
    texts[50] = texts[51] = texts[2]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd():
    """Nulls in every column, empty and long texts, repeated rows."""
    return [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0),
            (3, " \t\n ", "en", "s", 4), (4, "word " * 5000, "en", "s", 25000), (4, "word " * 5000, "en", "s", 25000),
            (5, "Ünï cödé 中文字 😀 x", "de", "t", 18), (6, "x" * 20000, "en", "s", 20000), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 4 else 0, 1 if i % 7 == 0 else 0) for i in range(60)]
                                 + [(None, 1, 1), (3, None, None)], "doc_id long, quality long, toxic long")


def frame(spark, rows):
    """With a further column whose name operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("own")).withColumn("ids", F.lit(1))


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(rows, k):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, corpus):
    from citeweave.llm.minhash_dedup import near_duplicates, one_of_each
    want = groups(corpus, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, corpus), 4).collect()}
    assert got == want
    left = one_of_each(frame(spark, corpus), 4)
    assert left.columns == frame(spark, corpus).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({g for _, g in want.values()})


def test_near_duplicates_large_group(spark):
    """A group beyond COLD whose members are near to their origin only."""
    from citeweave.llm.minhash_dedup import near_duplicates
    rng = random.Random(1)
    base = words_of(rng, 120)
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(120), 2):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    want = groups(rows, 4)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components(spark):
    from citeweave.llm.components import components
    edges = [(i + 1, i) for i in range(40)] + [(100, 90), (90, 95)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_passages(spark, corpus):
    from citeweave.llm.substring_dedup import duplicate_passages, without_duplicates
    found = duplicate_passages(frame(spark, corpus)).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in found}
    assert {(17, 5), (40, 5)} <= pairs
    grams = collections.defaultdict(set)
    for i, t, *_ in corpus:
        w = t.split()
        for j in range(len(w) - 49):
            grams[tuple(w[j:j + 50])].add(i)
    exact = set().union(*[v - {min(v)} for v in grams.values() if len(v) > 1])
    assert exact <= {a for a, _ in pairs}
    clean = {i for i, t, *_ in corpus} - {5, 17, 40, *range(20, 28), 2, 50, 51}
    assert not clean & {x for p in pairs for x in p}
    left = {r.doc_id: r.text for r in without_duplicates(frame(spark, corpus)).collect()}
    assert left[5] == corpus[5][1] and len(left[17].split()) == 70
    assert all(left[i] == corpus[i][1] for i in clean)


def test_repeated_lines_are_passages():
    """A line repeated in both texts, of any length, at any number of repeats."""
    from citeweave.llm.substring_dedup import align, longest_runs
    rng = np.random.default_rng(1)
    for size, m, n in [(12, 10, 10), (12, 10, 7), (3, 40, 30), (1, 90, 60), (7, 12, 30)]:
        line = rng.integers(1, 1 << 40, size).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(1, 1 << 40, 20).astype(np.uint64), np.tile(line, k),
                                rng.integers(1, 1 << 40, 20).astype(np.uint64)]) for k in (m, n))
        got = align(a, b, np.ones(len(a), bool), 5, 50, 80)
        inside = {p for s, k, *_ in got for p in range(s, s + k - 4)}
        assert inside >= set(range(20, 20 + size * m))
        assert all((a[s:s + k - 4] == b[u:u + v - 4]).all() for s, k, u, v, like in got if like == 1.0)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 3, 80)
    length, at = longest_runs(a, b)
    for i in range(60):
        best = max(next((k for k in range(61) if i + k >= 60 or j + k >= 80 or a[i + k] != b[j + k])) for j in range(80))
        assert length[i] == best and (a[i:i + best] == b[at[i]:at[i] + best]).all()


def test_near_passages_need_one_function(spark):
    """Pairs of likeness 0.807: two of four functions would find 0.97 of them."""
    from citeweave.llm.substring_dedup import duplicate_passages
    rng, rows = random.Random(8), []
    for i in range(600):
        w = [f"p{i}x{rng.randrange(10 ** 6)}" for _ in range(51)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:25] + ["edit"] + w[26:]))]
    found = duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.select("doc_id").distinct().count() >= 0.99 * 600


def test_passages_around_a_frequent_line(spark):
    """Passages of larger ids hold a line that smaller documents have too."""
    from citeweave.llm.substring_dedup import duplicate_passages
    rng = random.Random(9)
    line = words_of(rng, 40)
    rows = [words_of(rng, 20) + line + words_of(rng, 20) for _ in range(20)]
    for _ in range(40):
        shared = words_of(rng, 8) + line + words_of(rng, 7)
        rows += [words_of(rng, 20) + shared + words_of(rng, 20) for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    pairs = {(r.doc_id, r.other_doc_id) for r in duplicate_passages(df).collect()}
    assert pairs >= {(21 + 2 * k, 20 + 2 * k) for k in range(40)}


@pytest.mark.parametrize("size", [30, 40, 45])
def test_near_passages_around_a_frequent_line(spark, size):
    """Pairs share 60 words, one of them changed, around a line that 20 smaller documents have."""
    from citeweave.llm.substring_dedup import duplicate_passages
    rng = random.Random(size)
    line = words_of(rng, size)
    rows = [words_of(rng, 20) + line + words_of(rng, 20) for _ in range(20)]
    for _ in range(100):
        shared = words_of(rng, 8) + line + words_of(rng, 52 - size)
        for edit in (False, True):
            text = list(shared)
            if edit:
                text[rng.randrange(60)] = f"edit{len(rows)}"
            rows.append(words_of(rng, 20) + text + words_of(rng, 20))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    pairs = {(r.doc_id, r.other_doc_id) for r in duplicate_passages(df).collect()}
    assert len(pairs & {(21 + 2 * k, 20 + 2 * k) for k in range(100)}) >= 99


def test_pairs_of_larger_ids_are_tied(spark):
    """Variants of one passage, each with another word changed: every two are a pair."""
    from citeweave.llm.substring_dedup import duplicate_passages
    rng = random.Random(4)
    base, rows = words_of(rng, 120), []
    for i in range(5):
        text = list(base)
        text[20 + 20 * i] = f"edit{i}"
        rows.append((i, " ".join(words_of(rng, 30) + text + words_of(rng, 30))))
    rows.append((5, rows[4][1]))
    found = duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in found}
    assert pairs == {(a, b) for a in range(5) for b in range(a)} | {(5, 4)}


def test_near_passages_of_frequent_tokens(spark):
    """Pairs share 64 words, one of them changed, whose tokens 12 smaller documents have in another order:
    every token is frequent, and no smaller document has the passage."""
    from citeweave.llm.substring_dedup import duplicate_passages
    rng, rows, want = random.Random(12), [], set()
    for _ in range(20):
        p = words_of(rng, 64)
        rows += [words_of(rng, 20) + p[40:] + p[20:44] + p[:24] + words_of(rng, 20) for _ in range(12)]
        want.add((len(rows) + 1, len(rows)))
        rows += [words_of(rng, 20) + t + words_of(rng, 20) for t in (p, p[:32] + ["edit"] + p[33:])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    pairs = {(r.doc_id, r.other_doc_id) for r in duplicate_passages(df).collect()}
    assert pairs >= want


def test_areas_hold_every_passage():
    """Against all stretches of short texts: every one that may be a passage lies in one area."""
    from citeweave.llm.substring_dedup import _areas
    rng = np.random.default_rng(7)
    for width, percent in ((6, 80), (4, 60), (1, 100)):
        for _ in range(60):
            sizes = rng.integers(0, 30, 4)
            offs = np.concatenate([[0], np.cumsum(sizes)])
            shared = rng.random(offs[-1]) < rng.choice([0.5, 0.8, 0.95])
            at, first, last = _areas(shared, offs, width, percent)
            area = {int(x): (int(a), int(b)) for x, a, b in zip(at, first, last)}
            assert all(a <= x <= b and shared[a] and shared[b] for x, (a, b) in area.items())
            for low, high in zip(offs[:-1], offs[1:]):
                assert all(low <= a and b < high for x, (a, b) in area.items() if low <= x < high)
                for a in range(low, high):
                    for b in range(a + width - 1, high):
                        common, size = int(shared[a:b + 1].sum()), b - a + 1
                        if (shared[a] and shared[b] and 100 * common >= percent * size
                                and (100 + percent) * common >= percent * (size + width)):
                            assert area[a] == area[b] and area[a][0] <= a and b <= area[a][1]


def test_tables_leave_no_shuffle_files(spark):
    """Each step of the passages is written out; the shuffles that made it do not stay on disk."""
    from citeweave.session import cut_lineage
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = files.getAllFiles().mkString("\n").split("\n")
        return {os.path.basename(n) for n in names if os.path.basename(n).startswith("shuffle_")}
    before = shuffles()
    table = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 777).alias("k")).count())
    assert not shuffles() - before
    assert table.count() == 777 and table.agg(F.sum("count")).first()[0] == 10_000


def test_only_rare_tokens_get_rows():
    """Tokens inside windows are counted once a text; rows with places are of those wanted only."""
    from citeweave.llm.substring_dedup import _single
    rng = random.Random(3)
    line, own = words_of(rng, 12), words_of(rng, 12)
    texts = [" ".join(line + own + line), " ".join(line)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array(texts), pa.array([[{"l": 0, "r": 31}], [{"l": 0, "r": 7}]])],
        names=["doc_id", "text", "spots"])
    keys = [k for b in _single(5)([batch]) for k in b.column("key").to_pylist()]
    count = collections.Counter(keys)
    assert sorted(count.values()) == [1] * 16 + [2] * 8 and len(keys) == 32
    rare = np.array(sorted(k for k, n in count.items() if n == 1), dtype=np.int64).view(np.uint64)
    rows = [r for b in _single(5, lambda t: np.isin(t, rare))([batch]) for r in b.to_pylist()]
    assert sorted(r["l"] for r in rows) == list(range(8, 24)) and all(r["doc_id"] == 1 and r["first"] for r in rows)


def test_only_pairs_with_a_common_stretch_are_aligned(monkeypatch):
    """Most regions share a few words only: these are told without aligning them; no passage is lost."""
    from citeweave.llm import substring_dedup
    rng, align, calls = random.Random(6), substring_dedup.align, []
    monkeypatch.setattr(substring_dedup, "align", lambda *a: calls.append(1) or align(*a))
    rows, want = [], set()
    for i in range(300):
        a, b = (words_of(rng, rng.randrange(50, 200)) for _ in range(2))
        line = words_of(rng, 60 if i % 10 == 0 else 12)
        a[20:20] = line
        if i % 20 == 0:
            line = line[:30] + ["edit"] + line[31:]  # likeness 0.83
        b[7:7] = line
        rows.append((i, 0, 1000 + i, 0, " ".join(a), " ".join(b)))
        want |= {i} if i % 10 == 0 else set()
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                       names=["doc_id", "l", "other", "lb", "text_a", "text_b"])
    found = [r for b in substring_dedup._verify(5, 50, 80)([batch]) for r in b.to_pylist()]
    assert {r["doc_id"] for r in found} == want and len(calls) < 60


def test_compact_windows_are_minima_of_their_stretch():
    """Every stretch of ``width`` tokens lies in the window of its least value, equal values included;
    a window ends where a smaller value, or the text, does."""
    from citeweave.llm.substring_dedup import compact_windows, whole_windows
    from citeweave.llm.words import mix
    rng = np.random.default_rng(2)
    offsets = np.cumsum([0, 30, 0, 9, 46, 200, 10, 75])
    tokens = rng.integers(1, 60, offsets[-1]).astype(np.uint64)
    for width, function in ((10, 0), (1, 1), (16, 2)):
        value = mix(tokens ^ mix(np.full(1, function + 1, dtype=np.uint64))).tolist()
        want = set()
        for d, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for c in {min(range(x, x + width), key=lambda i: (value[i], i)) for x in range(s, e - width + 1)}:
                left, right = c, c
                while left > s and (value[left - 1], left - 1) > (value[c], c):
                    left -= 1
                while right < e - 1 and (value[right + 1], right + 1) > (value[c], c):
                    right += 1
                want.add((d, c - s, left - s, right - s))
        got = compact_windows(tokens, offsets, whole_windows(offsets, width), width, function)
        assert len(got[0]) == len(want) and set(zip(*(x.tolist() for x in got))) == want


def test_sharding(spark, corpus):
    from citeweave.llm.sharding import dealt, rebalanced, shard_documents
    rows = shard_documents(frame(spark, corpus)).collect()
    total = collections.Counter()
    for r in rows:
        text = corpus[r.doc_id][1]
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        total[r.shard] += r.size
    assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) <= max(r.size for r in rows)
    for s in total:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    loads = {s: random.Random(s).randrange(1, 99) for s in range(4096)}
    old = dealt(loads, 8)
    new = rebalanced(old, loads, 9)
    moved = [b for a, b in zip(old, new) if a != b]
    assert len(moved) < 1.1 * 4096 / 9 and sum(b == 8 for b in moved) > 0.95 * len(moved)
    sums = [sum(loads[s] for s in range(4096) if new[s] == k) for k in range(9)]
    assert max(sums) - min(sums) < 99


def test_stored_shard_map_is_edited(spark, tmp_path):
    from citeweave.llm.sharding import newest_version, read_map, shard_documents
    path = str(tmp_path / "map")
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 AS int)) AS text")

    def place(df, shards):
        rows = [tuple(r) for r in shard_documents(df, shards, map_path=path).collect()]
        version = newest_version(spark, path)
        return sorted(rows, key=str), version, {r.virtual_slot: r.shard for r in read_map(spark, path, version).collect()}

    rows, version, first = place(docs, 8)
    assert place(docs, 8) == (rows, version, first)
    _, grown, second = place(docs, 9)
    moved = {s for s in first if first[s] != second[s]}
    assert grown == version + 1
    assert len(moved) < 1.2 * 4096 / 9 and sum(second[s] == 8 for s in moved) > 0.9 * len(moved)
    assert {r.virtual_slot: r.shard for r in read_map(spark, path, version).collect()} == first
    _, _, third = place(docs, 7)
    assert set(third.values()) <= set(range(7))
    with pytest.raises(ValueError):
        shard_documents(docs, 8, slots=64, map_path=path)


def test_base_rules(spark, corpus):
    from citeweave.llm.fertility import quality_rules
    rows = corpus + [(100, "a b c a b c a b c\nx y\nx y\n\n\nx y " + "#* " * 3, "en", "s", 0)]
    for r in quality_rules(frame(spark, rows)).collect():
        text = dict((i, t) for i, t, *_ in rows)[r.doc_id]
        w = WORD.findall(text)
        seen = collections.defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i:i + 3])].append(i)
        repeated = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_bands_of_small_languages(spark):
    """A language is judged by its own band, with 99 documents as with 100."""
    from citeweave.llm.fertility import quality_rules
    rng = random.Random(2)
    text = lambda pool: " ".join(rng.choice(pool) for _ in range(80))
    main = ["".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(400)]
    rare = ["".join(chr(0x1401 + rng.randrange(600)) for _ in range(5)) for _ in range(400)]
    for n in (3, 99, 100):
        rows = [(i, text(main), "en", "s", 0) for i in range(300)] + [(1000 + i, text(rare), "cr", "s", 0) for i in range(n)]
        kept = [r.kept for r in quality_rules(frame(spark, rows)).where("lang = 'cr'").collect()]
        assert len(kept) == n and sum(kept) >= 0.9 * n


def test_winnowing_at_every_position_of_unspaced_text(spark):
    from citeweave.llm.winnowing import fingerprint, tokens_of
    rng = random.Random(4)
    run = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    rows = [(0, run), (1, run[:3] + "x" + run[3:]), (2, "yz" * 7 + run[50:] + " end"), (3, "ab abcdefgh abcdefghij")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", tokens_of(F.col("text")).alias("t"),
                                          fingerprint(F.col("text")).alias("p")).collect()}
    assert got[3].t == ["ab", "abcdefgh", "abcdefgh", "bcdefghi", "cdefghij"]
    own = set(got[0].p.hashes)
    assert len(own & set(got[1].p.hashes)) > 0.8 * len(own) and len(own & set(got[2].p.hashes)) > 0.7 * len(own)


def test_winnowing(spark, corpus):
    from citeweave.llm.winnowing import GRAM, WINDOW, fingerprint, fingerprint_documents
    df = frame(spark, corpus)
    tokens = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]{1,8}"), F.lit(0))
    grams = F.transform(tokens, lambda x, i: F.xxhash64(x, *[F.get(tokens, i + j) for j in range(1, GRAM)]))
    for r in df.select("doc_id", tokens.alias("t"), grams.alias("g"), fingerprint(F.col("text")).alias("p")).collect():
        g = r.g[:max(len(r.t) - GRAM + 1, min(len(r.t), 1))]
        want = set()
        for i in range(max(1, len(g) - WINDOW + 1)):
            window = g[i:i + WINDOW]
            low = min(h >> 32 for h in window)
            want.add(i + max(j for j, h in enumerate(window) if h >> 32 == low))
        assert r.p.places == sorted(want) and r.p.hashes == [g[i] for i in sorted(want)]
    import hashlib
    out = {r.doc_id: r for r in fingerprint_documents(df).collect()}
    for i, t, *_ in corpus:
        n, nxt = len(t), corpus[(i + 1) % len(corpus)][1]
        q = n // 4
        assert out[i].edited_sha256 == hashlib.sha256((t[:n - q] + nxt[:q]).encode()).hexdigest()
    assert out[50].fingerprint == out[2].fingerprint and out[50].near_next == 1.0


def test_mixing_targets(spark, corpus):
    from citeweave.llm.mixing import mix, mixed
    rows = mix(frame(spark, corpus)).collect()
    size, taken, target, most = (collections.Counter() for _ in range(4))
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    capped, budget = set(), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and level * weight[s] >= 2 * size[s]}
        if not more:
            break
        capped |= more
    for s in size:
        assert target[s] == pytest.approx(2 * size[s] if s in capped else level * weight[s])
        assert abs(taken[s] - target[s]) <= most[s]
    copies = collections.Counter(r.doc_id for r in mixed(frame(spark, corpus)).collect())
    assert copies == {r.doc_id: r.copies for r in rows if r.copies}


def test_sentencepiece_matches_the_library(spark, corpus, odd):
    import sentencepiece
    from citeweave.llm.sentencepiece_fst import decode, encode
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    letters = "abcdefgh ABC  \n\t.,!?éüß0123中文字😀\x00"
    extra = [(200 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(60))), None, None, 0) for i in range(300)]
    extra += [(900, " " * 40 + "the", None, None, 0), (901, "a" * 700, None, None, 0)]
    rows = corpus + extra + odd
    for r in decode(encode(frame(spark, rows))).collect():
        assert r.decoded == r.text
        assert r.ids == (None if r.text is None else sp.encode(r.text))


def test_long_cuts_beside_many_medium_ones():
    """Memory follows the characters of the cuts, not the longest cut times their number."""
    import tracemalloc

    import sentencepiece

    from citeweave.llm.sentencepiece_fst import load
    from citeweave.llm.words import text_bytes
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(520, 800))) for _ in range(300)]
    texts.append("".join(rng.choice(letters) for _ in range(6000)))
    with open(MODEL, "rb") as f:
        t = load(f.read())
    tracemalloc.start()
    ids, offs = t.encode(*text_bytes(pa.array(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    for i, x in enumerate(texts):
        assert ids[offs[i]:offs[i + 1]].tolist() == sp.encode(x)


def test_unigram_paths():
    """Path weights of a unigram reading of the pieces equal the library's."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from citeweave.llm.sentencepiece_fst import Transducer
    from citeweave.llm.words import text_bytes
    with open(MODEL, "rb") as f:
        m = pb.ModelProto.FromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = max(p.score, -40000.0) / 3000
    t, sp = Transducer(m.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["the quick brown fox", "unbelievable things happen", "naïve 中文 text"]
    ids, offs = t.encode(*text_bytes(pa.array(texts)))
    for i, x in enumerate(texts):
        cost = lambda a: sum(t.cost[j] for j in a)
        assert cost(ids[offs[i]:offs[i + 1]]) == pytest.approx(cost(sp.encode(x)), rel=1e-5)


def ppm_reference(train, order):
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        seq = b"\0" * order + t + b"\0"
        for i in range(order, len(seq)):
            for k in range(order + 1):
                counts[seq[i - k:i]][seq[i]] += 1

    def score(t):
        seq, out = b"\0" * order + t + b"\0", 0.0
        for i in range(order, len(seq)):
            gone = set()
            for k in range(order, -1, -1):
                seen = {s: c for s, c in counts.get(seq[i - k:i], {}).items() if s not in gone}
                if not counts.get(seq[i - k:i]):
                    continue
                total = sum(seen.values()) + len(seen)
                if seq[i] in seen:
                    out += math.log10(seen[seq[i]] / total)
                    break
                if seen:
                    out += math.log10(len(seen) / total)
                gone |= set(seen)
            else:
                out -= math.log10(256 - len(gone))
        return out
    return score


def test_ppm(spark, corpus):
    from citeweave.llm.ppm import ORDER, score_documents
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    rows = corpus + [(300, "Ünseen \x01 Words", "en", "s", 0), (301, None, None, None, None)]
    text = {i: (t or "").translate(low) for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in text}
    score = ppm_reference([text[i].encode() for i in text if not held[i]], ORDER)
    tokens = {i: [*WORD.findall(t), None] for i, t in text.items()}
    c = collections.Counter(x for i in text if not held[i] for x in tokens[i])
    n, v = sum(c.values()), len(c)
    for r in score_documents(frame(spark, rows)).collect():
        assert r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (
            len(tokens[r.doc_id]), sum(c[x] > 0 for x in tokens[r.doc_id]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens[r.doc_id]))
        assert r.score == pytest.approx(score(text[r.doc_id].encode()))


@pytest.mark.parametrize("pairs", [0, 40, 1 << 21])
def test_ppm_counts_rare_grams_beside_a_small_fast_path(spark, corpus, monkeypatch, pairs):
    """Scores do not depend on the size of the fast path."""
    from citeweave.llm import ppm
    monkeypatch.setattr(ppm, "PAIRS", pairs)
    rows = [(i, t, None, None, None) for i, t, *_ in corpus[:30]] + [(300, "seldom \u00fcsed \x01 words", None, None, None)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    score = ppm_reference([t.encode() for i, t, *_ in rows if not held[i]], ppm.ORDER)
    got = {r.doc_id: r.score for r in ppm.score_documents(frame(spark, rows)).collect()}
    assert got == {i: pytest.approx(score(t.encode())) for i, t, *_ in rows}


def test_classifiers_on_held_out_labels(spark):
    """Trained on three quarters of the labels, judged on the rest."""
    from citeweave.llm.ordinal import quality, rated
    from citeweave.llm.toxicity import toxicity
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, all_labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = all_labels.where("doc_id % 4 <> 0"), all_labels.where("doc_id % 4 = 0")
    docs = docs.join(all_labels.select("doc_id"), "doc_id", "left_semi")
    p = toxicity(docs, train).join(test, "doc_id").toPandas()
    assert (p[p.toxic == 1].p_toxic >= 0.5).mean() > 0.75 and (p[p.toxic == 0].p_toxic >= 0.5).mean() < 0.005
    g = quality(docs, rated(train)).join(test, "doc_id").toPandas()
    assert g[g.quality == 1].kept.mean() > 0.98 and g[g.quality == 0].kept.mean() < 0.3
    assert (g.p_grade_1 >= g.p_grade_2).all()


def test_ordinal_gradient_recovers_order():
    from citeweave.llm.hashed_text import Rows
    from citeweave.llm.ordinal import Ordinal
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    slots = np.concatenate([[g, 10 + rng.integers(0, 5)] for g in grade])
    m = Ordinal.fit(Rows(np.arange(0, 1201, 2), slots, np.ones(1200)), grade, 2)
    assert m.thresholds[0] < m.thresholds[1] and m.weights[0] < m.weights[1] < m.weights[2]


def test_odd_rows_and_empty_tables(spark, odd, labels):
    from citeweave.llm import fertility, minhash_dedup, mixing, ordinal, ppm, sharding, substring_dedup, toxicity, winnowing
    runs = [lambda d: minhash_dedup.near_duplicates(d), lambda d: sharding.shard_documents(d),
            lambda d: fertility.quality_rules(d), lambda d: winnowing.fingerprint_documents(d),
            lambda d: mixing.mix(d), lambda d: ppm.score_documents(d),
            lambda d: toxicity.toxicity(d, labels), lambda d: ordinal.quality(d, ordinal.rated(labels))]
    for run in runs:
        assert run(frame(spark, odd)).count() == len(odd)
        assert run(frame(spark, [])).count() == 0
    assert substring_dedup.duplicate_passages(frame(spark, odd)).count() == 0
    same = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, odd)).collect() if r.doc_id is not None}
    assert all(same[i].kept and same[i].component_id == i for i in (1, 2, 3, 4, 5, 6))


def test_pipeline_stages(spark, corpus, odd, tmp_path):
    import corpus_pipeline
    rows = [(i, t, "en", "s", 0) for i, t, *_ in corpus] + odd
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    (spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality long, toxic long")
     .write.parquet(str(tmp_path / "labels.parquet")))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(frame(spark, rows).columns) | {"ids", "n_tokens"} == set(out.columns)
    left = {r.doc_id for r in out.collect()}
    assert not left & {50, 51, *range(21, 28)}
    empty = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0, name
