"""Each operator against a brute-force version, on texts with every awkward case."""

import base64
import functools
import gzip
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from markerloom.llm import bucket_links, decontamination, langid, line_rules, lm_trie, minhash, packing, rule_ensemble, suffix_dedup, token_trie, warc
from markerloom.llm.bpe import ByteBpe, vocabulary_path, vocabulary_pattern
from markerloom.llm.elias_fano import EliasFano
from markerloom.llm.textvec import grams, words
from tests.llm.corpus import DOCS, awkward, frame, prose, word


@pytest.fixture(scope="module")
def texts():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def crc(i):
    return zlib.crc32(str(i).encode())


# -- words ---------------------------------------------------------------------------------------------------------------


def test_words_are_those_of_bytes_split(texts):
    for lower in (True, False):
        w = words(pa.array([t for _, t in texts], pa.string()), lower=lower)
        h = w.hashes()
        seen = {}
        for i, (_, t) in enumerate(texts):
            own = [w.text(j) for j in range(w.bounds[i], w.bounds[i + 1])]
            assert own == tokens(t, lower)
            for x, v in zip(own, h[w.bounds[i] : w.bounds[i + 1]].tolist()):
                assert seen.setdefault(x, v) == v
        assert len(set(seen.values())) == len(seen)


def test_words_of_slices_and_of_nothing():
    a = pa.array(["a b", None, "c", "", "d  e"])[1:4]
    w = words(a)
    assert [w.text(j) for j in range(len(w.starts))] == [b"c"] and w.bounds.tolist() == [0, 0, 1, 1]
    assert words(pa.array([], pa.string())).bounds.tolist() == [0]


@pytest.mark.parametrize("k", [1, 2, 5, 9, 50])
def test_grams_are_equal_where_words_are(k):
    h = np.random.default_rng(0).integers(0, 4, 400).astype(np.uint64)
    g = grams(h, k)
    by = defaultdict(set)
    for i in range(len(h) - k + 1):
        by[tuple(h[i : i + k])].add(int(g[i]))
    assert all(len(x) == 1 for x in by.values()) and len({x for y in by.values() for x in y}) == len(by)


# -- 1 -------------------------------------------------------------------------------------------------------------------


def test_block_max_wand_finds_all_above_the_threshold():
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(5, 30))) for i in range(150)]
    df = Counter()
    hashes = {i: words(pa.array([t]), table=decontamination.PLAIN).hashes() for i, t in items}
    for h in hashes.values():
        df.update(set(h.tolist()))
    known = np.array(sorted(df), np.uint64)
    index = decontamination.ItemIndex(decontamination.ItemIndex.build(items, len(items), 15.0, known, np.array([df[int(t)] for t in known])))
    for least in (0.2, 0.5):
        for i in (3, 77, 120):
            query = np.unique(np.concatenate([hashes[i][::2], hashes[(i + 1) % 150][:4]]))
            terms = np.unique(index.lookup(query)[1]).tolist()
            expected = defaultdict(float)
            for t in terms:
                for k, v in zip(*index.postings(t)[:2]):
                    expected[k] += v
            got = dict(index.search(terms, least))
            assert set(got) == {k for k, v in expected.items() if v >= least - 1e-9}
            assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_impacts_are_those_of_bm25():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(1, 700))) for i in range(12)]
    bags = []
    for _, t in items:
        w = decontamination.plain_words(t)
        n = math.ceil(len(w) / decontamination.PART)
        bags += [Counter(w[len(w) * k // n : len(w) * (k + 1) // n]) for k in range(n)]
    df = Counter(w for _, t in items for w in set(decontamination.plain_words(t)))
    number = {w: int(words(pa.array([w.decode()]), table=decontamination.PLAIN).hashes()[0]) for w in df}
    known = np.array(sorted(number.values()), np.uint64)
    of_hash = {h: df[w] for w, h in number.items()}
    index = decontamination.ItemIndex(decontamination.ItemIndex.build(items, 12, 90.0, known, np.array([of_hash[int(h)] for h in known])))
    for k, bag in enumerate(bags):
        size = sum(bag.values())
        weight = {w: math.log(1 + (12 - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 90)) for w, tf in bag.items()}
        for w, v in weight.items():
            t = int(np.searchsorted(index.terms, np.uint64(number[w])))
            parts, impacts, tops = index.postings(t)
            assert impacts[parts.index(k)] == pytest.approx(v / sum(weight.values())) and max(tops) == max(impacts) and index.bounds[t].max() >= max(impacts)


@pytest.mark.parametrize("max_items", [5000, 7])
def test_leaks(spark, docs, none, max_items):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(14, 60))) for i in range(20)] + [(90, None), (91, ""), (None, prose(rng, 20)), (5, prose(rng, 300))]
    planted = [(1000 + n, i, t) for n, (i, t) in enumerate(items) if t]
    leaky = [(d, prose(rng, rng.randint(0, 700)) + " " + t.upper() + "! " + prose(rng, 40)) for d, _, t in planted]
    table = spark.createDataFrame(items, "item_id long, text string")
    both = docs.unionByName(frame(spark, leaky))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(both, table, max_items=max_items).collect()}
    assert got == {(d, i) for d, i, _ in planted}
    kept = decontamination.decontaminate(both, table, max_items=max_items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontamination.contaminated(none, table).count() == 0
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0 and decontamination.decontaminate(docs, table.limit(0)).count() == docs.count()


def test_leaks_of_long_and_of_tiny_items(spark):
    rng = random.Random(6)
    sizes = {1: 258, 2: 259, 3: 513, 4: 700, 5: 1500}
    items = {i: prose(rng, n - 5).rstrip(".") + ". Zu" + str(i) + " yo xe wa" + str(i) + " vi." for i, n in sizes.items()}
    assert all(len(decontamination.plain_words(t)) == sizes[i] and decontamination.question_and_answer(t)[1][-1] == b"vi" for i, t in items.items())
    items[6] = "Quo vadis"
    whole = [(100 + i, prose(rng, rng.randint(0, 900)) + " " + t.upper() + " " + prose(rng, 300)) for i, t in items.items()]
    questions = [(200 + i, prose(rng, 50) + " " + " ".join(t.split()[:-5]) + " " + prose(rng, 900)) for i, t in items.items() if i < 6]
    ends = [(300 + i, " ".join(t.split()[-5:]) + " " + prose(rng, 100) + " " + " ".join(t.split()[-2:][::-1])) for i, t in items.items() if i < 6]
    tiny = [(400, "They vadis " + prose(rng, 20) + " quo " + prose(rng, 20))]
    docs, table = frame(spark, whole + questions + ends + tiny), spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, table).collect()} == {(100 + i, i) for i in items}
    assert {r.doc_id for r in decontamination.decontaminate(docs, table).collect()} == {d for d, _ in questions + ends + tiny}


# -- 2 -------------------------------------------------------------------------------------------------------------------


def repeats_by_force(texts, least):
    own = {i: tokens(t, False) for i, t in texts if i is not None}
    where = defaultdict(list)
    for i in sorted(own):
        for s in range(len(own[i]) - least + 1):
            where[tuple(own[i][s : s + least])].append((i, s))
    removed, stays = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for n, (i, s) in enumerate(places):
                (removed if n else stays)[i].update(range(s, s + least))
    return removed, stays


@pytest.mark.parametrize("least,key_words", [(50, 10), (12, 3)])
def test_repeated_spans(docs, texts, none, least, key_words):
    removed, stays = repeats_by_force(texts, least)
    got = defaultdict(set), defaultdict(set)
    for r in suffix_dedup.repeated_spans(docs, least=least, key_words=key_words).collect():
        got[not r.removed][r.doc_id].update(range(r.start_word, r.end_word))
        assert r.keeper <= r.doc_id
    assert got == (removed, stays)
    assert suffix_dedup.repeated_spans(none).count() == 0


def test_remove_repeats(docs, texts, none):
    removed, _ = repeats_by_force(texts, 50)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for i, t in texts:
        if i is None or i not in removed:
            assert t in [r.text for r in by_id[i]]
            continue
        left = [w for k, w in enumerate(tokens(t, False)) if k not in removed[i]]
        assert [tokens(r.text, False) for r in by_id[i]][:1] == ([left] if left else [])
        assert all(r.n_chars == len(r.text) for r in by_id[i])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_least_places():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 300).astype(np.uint64)
    keys[::7] = keys[3]
    for width in (1, 2, 35, 300, 301):
        high = keys >> np.uint64(26)
        assert suffix_dedup.least_places(keys, width).tolist() == [i + int(high[i : i + width].argmin()) for i in range(len(keys) - width + 1)]


# -- 3 -------------------------------------------------------------------------------------------------------------------


def test_line_rules(docs, texts, none):
    got = {r.doc_id: r for r in line_rules.judge(docs).collect()}
    for i, t in texts:
        if i is None:
            continue
        w = [x.decode() for x in tokens(t, False)]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        windows = Counter(zip(*[w[k:] for k in range(5)]))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert got[7].kept and got[14].kept and not got[17].kept
    assert line_rules.judge(none).count() == 0
    assert "Python" not in line_rules.judge(docs)._jdf.queryExecution().toString() and "Arrow" not in line_rules.judge(docs)._jdf.queryExecution().toString()
    assert {r.doc_id: r.text for r in line_rules.clean(docs).collect()}[17] is None


# -- 4 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [500_000, 1])
def test_warc_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    monkeypatch.setattr(warc, "FILTER_BITS", 1 << 10)
    big = "<p>" + "y" * 300_000 + "</p>"
    pages = [(1, "http://a/", "<p>é</p>" * 30), (2, None, "<p>é</p>" * 30), (3, "http://b\r\nX: 1/", "small"), (4, "http://c/", "small"), (5, "u", None), (6, "u", ""), (7, "u", big), (None, "u", "<p>é</p>" * 30), (9, "u", big), (7, "u", big), (10, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("file", F.lit(2))
    path = f"file://{tmp_path}/w"
    index = warc.write(df.repartition(3), path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload).decode()) for r in warc.read(index, path).collect())
    expected = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        kind = "revisit" if len(data) >= 100 and i is not None and i != min(same) else "response"
        expected.append((i or 0, kind, min(same) if kind == "revisit" else None, len(data), hashlib.sha256(data).hexdigest(), data.decode() if kind == "response" else ""))
    assert got == sorted(expected, key=lambda x: (x[0], x[1]))
    one = warc.read(index.where("page_id = 9 OR page_id = 3"), path).collect()
    assert sorted(r.page_id for r in one) == [3, 9]
    for r in index.where("page_id = 10").collect():
        data = (tmp_path / "w" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(data).endswith(b"a\r\n\r\nb\r\n\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_ranges_join_neighbours():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (1000, 1)], gap=90, span=500) == [(0, 105, 3), (1000, 1001, 1)]
    assert warc.ranges([(0, 10), (10, 5)], gap=90, span=12) == [(0, 10, 1), (10, 15, 1)]


# -- 5 -------------------------------------------------------------------------------------------------------------------


def test_token_counts(docs, texts, none):
    ranks = vocabulary_path("byte_bpe_50k.tiktoken")
    lines = [line.split() for line in open(ranks, "rb")]
    total = sum(1 / (int(r) + 2) for _, r in lines)
    probability = {base64.b64decode(p): 1 / (int(r) + 2) / total for p, r in lines}
    longest = max(map(len, probability))
    assert sum(map(math.exp, token_trie.counts_of(ranks).trie.scores.values())) == pytest.approx(1)

    @functools.cache
    def by_force(w):
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            options = [(best[b][0] + math.log(probability[w[b:end]]), -best[b][1] - 1) for b in range(max(0, end - longest), end) if w[b:end] in probability]
            s, n = max(options)
            best.append((s, -n))
        return best[-1][1]

    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_trie.token_counts(docs, ranks, vocabulary_pattern()).collect()}
    for i, t in texts:
        if i is not None:
            w = [m.group().encode() for m in regex.finditer(vocabulary_pattern(), t or "")]
            assert b"".join(w) == (t or "").encode()
            assert got[i] == (len(w), sum(map(by_force, w)))
    assert got[3][1] > 0 and token_trie.token_counts(none, ranks, vocabulary_pattern()).count() == 0


def test_trie_is_begun_anew_without_changing_counts():
    rng = random.Random(4)
    scores = {bytes([c]): -9.0 for c in range(97, 123)} | {b"ab": -3.0, b"abc": -5.0, b"ka": -1.0, b"kaka": -2.0}
    small, large = token_trie.UnigramTrie(scores, 5), token_trie.UnigramTrie(scores)
    for w in [word(rng).encode() for _ in range(300)] + [b"kaka", b"abcab", b"", b"\xff"]:
        assert small.count(w) == large.count(w)
    assert large.count(b"kaka") == 1  # of equal scores the fewer tokens


# -- 6 -------------------------------------------------------------------------------------------------------------------


def test_rule_ensemble(spark, none):
    rng = random.Random(6)
    good = [(i, prose(rng, rng.randint(20, 120))) for i in range(0, 300)]
    bad = [(i, " ".join(word(rng) + rng.choice(["&&&", "$$$", "###"]) for _ in range(50))) for i in range(300, 400)]
    table = frame(spark, good + bad + [(900, None), (901, ""), (None, prose(rng, 30))])
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = rule_ensemble.fit(table, labels)
    assert model.rules
    rows = rule_ensemble.score(table, model).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in rows if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.97
    kept = rule_ensemble.keep(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted for r in rows)
    flat = rule_ensemble.fit(table, labels.limit(0))
    assert {r.score for r in rule_ensemble.score(table, flat).collect()} == {0.5}
    assert rule_ensemble.score(none, model).count() == 0


def test_rules_by_hand(spark, docs, texts):
    """The statistics of the awkward corpus in plain Python, and the rules on them, against the column expression."""
    rng = random.Random(3)
    stats, names = rule_ensemble.statistics(docs.where("doc_id IS NOT NULL").withColumn("raw", F.col("text")), "doc_id", "raw")
    blank, x = "\x20\t\n\x0b\x0c\r", {}
    for _, t in texts:
        t = t or ""
        w, lines = [v for v in re.split(f"[{blank}]+", t) if v], [v for v in t.split("\n") if v.strip(blank)]
        many = lambda chars: sum(t.count(c) for c in chars)  # noqa: E731,B023
        n, c, k = max(len(w), 1), max(len(t), 1), max(len(lines), 1)
        x[t] = [many("#*$%&|<>") / c, many("|") / c, many("!") / c, many(rule_ensemble.UPPER) / c, many("0123456789") / c, many(".?!…") / n, many(",;:") / n, sum(map(len, w)) / n, math.log1p(len(w)),
                len(set(w)) / n, len(w) / k, len(set(lines)) / k, sum(bool(re.search("[.!?…\"'”»)]\\s*$", v)) for v in lines) / k]
    rows = stats.collect()
    assert len(rows) == sum(i is not None for i, _ in texts) and all([r[c] for c in names] == pytest.approx(x[r.raw or ""]) for r in rows)
    table = np.array(list(x.values()))
    cut = lambda k: float(np.sort(table[:, k])[len(table) // 2]) + 1e-6
    rules = [rule_ensemble.Rule(tuple((k, rng.random() < 0.5, cut(k)) for k in rng.sample(range(len(names)), rng.randint(1, 3)))) for _ in range(30)]
    model = rule_ensemble.Ensemble(names, 0.2, [(r, rng.uniform(-1, 1)) for r in rules])
    for r in rule_ensemble.score(docs.where("doc_id IS NOT NULL"), model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        own = x[r.text or ""]
        total = 0.2 + sum(w for rule, w in model.rules if all((own[k] <= v) == at_most for k, at_most, v in rule.terms))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))) and r.predicted == int(r.score >= 0.3)
        assert all(rule.holds(np.array([own]))[0] == all((own[k] <= v) == at_most for k, at_most, v in rule.terms) for rule in rules)


def test_lasso_is_sparse_and_right():
    rng = np.random.default_rng(1)
    z = (rng.random((2000, 12)) < 0.5).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    _, w = rule_ensemble.lasso_logistic(z, y, 0.01)
    assert w[0] > 1 and w[1] < -1 and np.abs(w[2:]).max() < 0.2 and (w == 0).sum() > 4


# -- 7 -------------------------------------------------------------------------------------------------------------------


def components_by_force(texts, k, percent):
    sets = {i: bucket_links.shingles(t, k) for i, t in texts if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and bucket_links.similar(sets[a], sets[b], percent):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, texts, none, k):
    expected = components_by_force(texts, k, 80)
    rows = minhash.near_duplicates(docs, k=k).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    kept = minhash.deduplicate(docs, k=k)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted({(i, t or "") for i, t in texts if i is not None and expected[i][1] == i} | {(-1, t or "") for i, t in texts if i is None})
    assert minhash.near_duplicates(none).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = lambda t: t.replace(" ", " zz ", 1)
    df = frame(spark, [(5, near(b)), (7, a), (7, b), (7, a), (9, near(a)), (8, c), (8, near(c))])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=2).collect())
    assert got == [(5, 5, True), (7, 5, False), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True), (9, 7, False)]
    assert sorted((r.doc_id, r.text) for r in minhash.deduplicate(df, k=2).collect() if r.doc_id != 8) == sorted([(5, near(b)), (7, a)])


def test_blocks_grow_in_proportion_to_the_group(spark):
    """Rows that are dealt out, and each pair of members in different components in exactly one task."""
    def of(n, others):
        rows = [(1, i, 1, 10, True) for i in range(n)] + [(1, n + i, 100 + i, 10, False) for i in range(others)]
        return bucket_links._blocks(spark.createDataFrame(rows, "grp long, rep long, component long, n int, main boolean"))

    few, many = of(2 * bucket_links.BLOCK, 40).count(), of(8 * bucket_links.BLOCK, 160).count()
    assert many <= 4.3 * few
    tasks = defaultdict(list)
    for r in of(bucket_links.BLOCK + 10, bucket_links.BLOCK + 10).where("rep % 100 = 0 OR rep > 4000").collect():
        tasks[r.i, r.j].append(r)
    met = Counter()
    for (i, _), rows in tasks.items():
        for x in rows:
            met.update((min(x.rep, y.rep), max(x.rep, y.rep)) for y in rows if not x.main and (y.main or (y.rep < x.rep and (i == 0 or (i < 0 and x.own != y.own)))))
    reps = {r.rep: r.main for rows in tasks.values() for r in rows}
    assert met == Counter({(min(x, y), max(x, y)): 1 for x in reps for y in reps if x < y and not (reps[x] and reps[y])})


def test_a_large_group_of_borderline_copies(spark, monkeypatch):
    """Chains of copies at the threshold, in buckets of several blocks: no link may be lost."""
    monkeypatch.setattr(bucket_links, "BLOCK", 20)
    rng = random.Random(9)
    base = [word(rng) for _ in range(80)]
    texts = [(i, " ".join(w if rng.random() > 0.06 else word(rng) for w in base)) for i in range(90)]
    expected = components_by_force(texts, 2, 80)
    assert 1 < len({c for _, c in expected.values()}) < 90
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts), k=2).collect()}
    assert got == expected


def test_components_of_a_long_path(spark):
    from markerloom.llm.components import components

    ids = list(range(60))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 60)} | {101: 100}
    assert components(links.limit(0)).count() == 0


# -- 8 -------------------------------------------------------------------------------------------------------------------


def test_memo_gives_the_ids_of_the_whole_text(texts):
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(vocabulary_path()), ByteBpe(vocabulary_path(), most=50)
    odd = ["a  b", " a", "a ", "a \n b", "\n\n x", "don't  you'll", "tab\tx y", "<|endoftext|> a", "x <|endoftext|>", "", " ", "naïve 漢字 😀 x", "a  b  c"]
    for t in [t or "" for _, t in texts] + odd:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def check_packing(rows, capacity=1024):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_doc, by_bin


def test_packing(docs, texts, none):
    encode = ByteBpe(vocabulary_path()).encode
    by_doc, by_bin = check_packing(packing.pack(docs, vocabulary_path()).collect())
    for i in (None, 7):  # repeated rows, and rows without an id, are packed each
        size = lambda t: len(encode(t or "")) // 4 + 1
        assert sum(r.length for r in by_doc[i]) == sum(size(t) for j, t in texts if j == i) and sorted(r.start for r in by_doc[i] if r.piece == 0) == [0, 0]
    for i, t in texts:
        if i is None or i == 7:
            continue
        ids, at = encode(t or "") + np.array([2], "<u4").tobytes(), 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        for n, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            assert r.length == 1024 or n == 0
            at += r.length
        assert 4 * at == len(ids)
    total = sum(r.length for x in by_bin.values() for r in x)
    assert len(by_bin) <= math.ceil(total / 1024) + 1
    assert packing.pack(none, vocabulary_path()).count() == 0


def test_underfull_bins_merge_over_rounds(spark):
    rng = random.Random(8)
    df = frame(spark, [(i, prose(rng, rng.randint(1, 60))) for i in range(300)]).repartition(40)
    rows = packing.pack(df, vocabulary_path(), fan_in=3).collect()
    _, by_bin = check_packing(rows)
    assert len(rows) == 300 and len(by_bin) <= math.ceil(sum(r.length for r in rows) / 1024) + 1


@pytest.mark.parametrize("block", [60, 1_000_000])
def test_no_underfull_bin_is_closed(spark, monkeypatch, block):
    rng = random.Random(9)
    long, short = [(i, "the " * rng.randint(600, 660)) for i in range(100)], [(i, "the " * rng.randint(345, 360)) for i in range(100, 200)]
    df = frame(spark, long).coalesce(2).unionByName(frame(spark, short).coalesce(2))
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "CARRY", 5, raising=False)
    rows = packing.pack(df, vocabulary_path(), fan_in=2).collect()
    _, by_bin = check_packing(rows)
    assert len(rows) == 200 and len(by_bin) <= len(packing.best_fit(np.array([r.length for r in rows]), 1024)[2]) + 1


def test_best_fit_of_counts():
    rng = np.random.default_rng(8)
    for capacity, n in [(10, 7), (100, 500), (1024, 3000)] * 20:
        lengths = rng.integers(1, rng.integers(2, capacity + 1), n)
        each, counts = np.unique(lengths, return_counts=True)
        plan = packing.best_fit_of_counts(dict(zip(each.tolist(), counts.tolist())), capacity)
        fills = np.zeros(len(packing.best_fit(lengths, capacity)[2]), np.int64)
        for m, total in zip(each.tolist(), counts.tolist()):
            own = [x for x in plan if x[0] == m]
            assert own[0][1] == 0
            for (_, first, to, offset, k), end in zip(own, [*[x[1] for x in own[1:]], total]):
                for i in range(end - first):
                    fills[to + i // k] += m
        taken = sorted((to + i // k, offset + i % k * m, m) for m, total in zip(each.tolist(), counts.tolist()) for own in [[x for x in plan if x[0] == m]] for (_, first, to, offset, k), end in zip(own, [*[x[1] for x in own[1:]], total]) for i in range(end - first))
        assert all(y[1] == (x[1] + x[2] if x[0] == y[0] else 0) for x, y in zip(taken, taken[1:]))
        assert sorted(fills.tolist()) == sorted(packing.best_fit(lengths, capacity)[2].tolist())


def test_best_fit():
    bins, offsets, fills = packing.best_fit(np.array([5, 6, 4, 4, 10, 1]), 10)
    assert fills.tolist() == [10, 10, 10] and sorted(zip(bins.tolist(), offsets.tolist())) == sorted(set(zip(bins.tolist(), offsets.tolist())))


# -- 9 -------------------------------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (1, 1000), (500, 600), (500, 10**12), (9000, 40000), (70000, 10**6)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        e = EliasFano.build(values, top)
        assert (e.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 200).astype(np.uint64)])
        assert (e.successor(asked) == np.searchsorted(values, asked)).all()
    distinct = np.unique(rng.integers(0, 10**6, 5000)).astype(np.uint64)
    assert (EliasFano.build(distinct, 10**6).get(np.arange(len(distinct))) == distinct).all()


@pytest.mark.parametrize("shard_tokens,order", [(4_000_000, 3), (300, 3), (300, 2), (4_000_000, 4), (4_000_000, 1)])
def test_language_model(docs, texts, none, monkeypatch, shard_tokens, order):
    """With few tokens to a file, frequent contexts have several."""
    monkeypatch.setattr(lm_trie, "SHARD_TOKENS", shard_tokens)
    known = [(i, t) for i, t in texts if i is not None and crc(i) % 10]
    grams_of = defaultdict(Counter)  # by context, of any length
    unigrams = Counter()
    path = lambda t: [b"\n", *tokens(t), b"\n"]
    for _, t in known:
        w = path(t)
        unigrams.update(w[1:])
        for k in range(1, len(w)):
            for n in range(1, order):
                if k >= n:
                    grams_of[tuple(w[k - n : k])][w[k]] += 1
    n, v, d = sum(unigrams.values()), len(unigrams), lm_trie.DISCOUNT

    def probability(context, w):
        lower = probability(context[1:], w) if context else (unigrams[w] + 0.1) / (n + 0.1 * (v + 1))
        own = grams_of.get(context) if context else None
        return (max(own[w] - d, 0) + d * len(own) * lower) / sum(own.values()) if own else lower

    model = lm_trie.fit(docs, order=order)
    assert len(model.levels) == order - 1 and (order == 1 or (model.levels[0].pieces.max() > 1) == (shard_tokens < 1000))
    rows = lm_trie.score(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            continue
        w = path(dict(texts)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 10 == 0, len(w) - 1, sum(unigrams[x] > 0 for x in w[1:]), n)
        assert r.base_score == pytest.approx(sum(math.log10(probability((), x)) for x in w[1:]))
        assert abs(r.score - sum(math.log10(probability(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w)))) <= 0.05 * (len(w) - 1)
    assert lm_trie.score(none, lm_trie.fit(none, order=order)).count() == 0
    untrained = lm_trie.score(docs, lm_trie.fit(none, order=order)).where("doc_id = 7").first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.score == untrained.base_score


# -- 10 ------------------------------------------------------------------------------------------------------------------


def test_language_id(spark, docs, none):
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "äöüßx"}
    rows, lang = [], {}
    for i in range(300):
        lang[i] = rng.choice(list(alphabets))
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang[i]]) for _ in range(5)) for _ in range(30))))
    rows += [(900, None), (901, ""), (902, "12 -- 3!"), (None, "abcde abcde")]
    lang |= {901: None, None: "zz"}
    table = frame(spark, rows, lang=lang)
    got = langid.identify(table, langid.fit(table)).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang[i] for i in range(300))
    assert all(by_id[i].held_out == (crc(i) % 5 == 0) for i in range(300))
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[None].lang_pred == "aa"
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(none, langid.fit(table)).count() == 0


def test_naive_bayes_by_hand(spark, docs, texts):
    """All n-grams counted in dictionaries (so many buckets that they share none), all posteriors in plain Python."""
    lang = {i: ("aa", "bb", "cc")[i % 3] for i, _ in texts if i is not None}
    table = frame(spark, texts, lang=lang)
    model = langid.fit(table, buckets=1 << 22)

    def grams_of(t):
        out = re.sub(" +", " ", " " + "".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in t))
        return [out[k : k + n] for n in (1, 2, 3) for k in range(len(out) - n + 1) if out[k : k + n] != " "]

    counts, docs_of = defaultdict(Counter), Counter()
    for i, t in texts:
        if i is not None and t is not None and crc(i) % 5:
            counts[lang[i]].update(grams_of(t))
            docs_of[lang[i]] += 1
    sums = {k: sum(c.values()) + 0.5 * (1 << 22) for k, c in counts.items()}
    for r in langid.identify(table, model).collect():
        t = dict(texts)[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is None:
            continue
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = {k: math.log(docs_of[k] / sum(docs_of.values())) + sum(math.log((counts[k][g] + 0.5) / sums[k]) for g in grams_of(t)) for k in sorted(counts)}
        best = max(total, key=lambda k: total[k])
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), abs=2e-3)
    assert model.langs == sorted(docs_of)


def test_many_languages(spark):
    """More languages than a worker keeps rows of, each with letters of its own: all are learned, the rarest too."""
    n = langid.HELD_ROWS + 40
    letters = [[chr(0x4E00 + 6 * k + j) for j in range(6)] for k in range(n)]
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(letters[i % n]) for _ in range(40))) for i in range(5 * n)]
    model = langid.fit(frame(spark, rows, lang={i: f"l{i % n:03d}" for i, _ in rows}), buckets=1 << 14)
    learned = sorted({f"l{i % n:03d}" for i, _ in rows if crc(i) % 5})
    assert model.langs == learned and len(learned) > langid.HELD_ROWS
    got = langid.identify(frame(spark, rows), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id % n:03d}" for r in got if f"l{r.doc_id % n:03d}" in learned)


# -- pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    good = [(i, prose(rng, 80)) for i in range(150)]
    passage, item = prose(rng, 70), prose(rng, 25)
    extra = [
        (150, good[3][1]),
        (151, good[4][1].replace(" the ", " a ", 1)),
        (152, prose(rng, 150) + " " + passage),
        (153, passage + " " + prose(rng, 150)),
        (154, prose(rng, 90) + " " + item + " " + prose(rng, 20)),
        *[(i, " ".join(word(rng) + "&&& ###" for _ in range(40))) for i in range(200, 240)],
    ]
    docs = frame(spark, good + extra).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good + extra], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now = now.cache()
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
    clean = set(range(155))
    assert ids == [clean, clean - {150, 151}, clean - {150, 151}, clean - {150, 151, 154}]
    assert passage not in {r.doc_id: r.text for r in now.collect()}[153]
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_pipeline_of_awkward_rows(spark, texts, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages; and empty tables."""
    import corpus_pipeline

    for name, rows in (("some", texts), ("none", [])):
        folder = f"{tmp_path}/{name}"
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1 if n % 3 else None, 0) for n, (i, _) in enumerate(rows)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, ""), (2, "no such text")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, call in corpus_pipeline.STAGES[:-1]:
            now = call(spark, now, folder).cache()
            assert now.columns == [f.name for f in DOCS], stage
        kept = now.collect()
        found = corpus_pipeline.run(spark, folder).collect()
        check_packing(found)
        assert {r.doc_id for r in found} == {r.doc_id for r in kept} and len(kept) == len({(r.doc_id, r.text) for r in kept})
        assert bool(kept) == bool(rows) and (not rows or {1, 2, 4, 7, 14, 15} <= {r.doc_id for r in kept})


def test_every_operator_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == [n for n in names if n.startswith("op")] and len([n for n in names if n.startswith("op")]) == 10
    assert "pipeline" in names
