import random
import re

import numpy as np
import pytest

from musterline.llm import ngram_join
from tests.llm import odd

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    """(doc_id, n_shingles, component_id) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)), key=repr)


def family(seed, n, words, edits):
    """Copies of one text with scattered edits: some linked, some not, some by chains only."""
    rand = random.Random(seed)
    base = odd.prose(seed, words, 3000).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rand.randrange(edits)):
            copy[rand.randrange(words)] = f"e{rand.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def got(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in ngram_join.ngram_join(docs).documents.collect()), key=repr)


def test_odd_rows(spark):
    docs = odd.clashing(odd.frame(spark))
    found = sorted((tuple(r) for r in ngram_join.ngram_join(docs).documents.collect()), key=repr)
    assert found == expected([(r[0], r[1]) for r in odd.rows()])


def test_empty(spark):
    assert ngram_join.ngram_join(odd.empty(spark)).documents.collect() == []


def test_near_copies_and_shared_passages(spark):
    passage = odd.prose(77, 40, 3000)
    texts = family(1, 25, 120, 9) + family(2, 25, 60, 5) + [odd.prose(100 + i, 50) + " " + passage for i in range(30)] + [passage] * 5
    rows = list(enumerate(texts))
    assert got(spark, rows) == expected(rows)


def test_many_copies_with_strays(spark):
    """A large group around one original, copies too far from it that link to others or to none, and equal rows."""
    rand = random.Random(4)
    base = odd.prose(11, 150, 3000).split()
    texts = [" ".join(base)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rand.choice([0, 1, 2, 3, 6, 9, 12])):
            copy[rand.randrange(150)] = f"e{rand.randrange(40)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(None, texts[5])] * 30 + [(3, texts[3])] * 20
    assert got(spark, rows, 5) == expected(rows)


def test_links_are_similar(spark):
    rows = list(enumerate(family(5, 15, 80, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for link in ngram_join.ngram_join(docs).links.collect():
        assert 100 * link["common"] >= 75 * link["total"]


@pytest.mark.parametrize("l", [1, 3, 8])
def test_longer_prefixes_share_more(l):
    """What the join relies on: similar sets share min(l) of their prefixes, in any common order."""
    import numpy as np

    rand, like = np.random.default_rng(l), ngram_join.Similarity()
    for _ in range(200):
        n = int(rand.integers(10, 80))
        x = rand.choice(10**6, n, replace=False)
        y = np.concatenate([x[: int(n * 0.9)], rand.choice(10**6, int(n * 0.05) + 1) + 10**7])
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        prefix = [np.sort(s)[: len(s) - int(like.least(np.int64(len(s)))) + l] for s in (x, y)]
        assert len(np.intersect1d(*prefix)) >= min(l, both)


def _set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))


@pytest.mark.parametrize("n", [1, 2, 31, 33, 64, 400, 3000])
def test_parities_bound_what_sets_have_in_common(n):
    """Never less than there is, for any sizes; close enough to tell a set from one that shares half of it."""
    rng = np.random.default_rng(n)
    x = _set(rng, n)
    for m, shared in ((n, n // 2), (n, n), (n + n // 4, n), (max(1, n // 9), n // 10), (5 * n, n)):
        y = np.union1d(x[:shared], _set(rng, m - shared)) if m > shared else x[:shared]
        most, total = ngram_join.most_common(ngram_join.parities(x), ngram_join.parities(y))
        assert total == len(x) + len(y)
        assert len(np.intersect1d(x, y)) <= most <= total // 2
    half = np.union1d(x[: n // 2], _set(rng, n - n // 2))
    if n >= 400:
        assert 175 * ngram_join.most_common(ngram_join.parities(x), ngram_join.parities(half))[0] < 75 * 2 * n


def test_very_frequent_shingles_get_a_longer_prefix():
    """Estimates of 2**20 candidates a shingle are compared as they are, not as what overflows."""
    tokens = _set(np.random.default_rng(1), 100)
    prefix, l = ngram_join.adaptive_prefix(tokens, np.full(ngram_join.CELLS, 20, np.uint8), ngram_join.Similarity())
    assert (len(prefix), l) == (33, 8)


def test_sieve_keeps_links_and_drops_what_cannot_link(spark):
    like, rng = ngram_join.Similarity(), np.random.default_rng(7)
    x = _set(rng, 500)
    sets = {1: x, 2: np.union1d(x[:450], _set(rng, 50)), 3: np.union1d(x[:250], _set(rng, 250)), 4: x[:380], 5: np.union1d(x[250:], _set(rng, 250))}
    scan = spark.createDataFrame([(k, bytearray(ngram_join.parities(v))) for k, v in sets.items()] + [(1, None)], "class long, parities binary")
    pairs = spark.createDataFrame([(a, b) for b in sets for a in sets if a < b], "a long, b long")
    kept = {tuple(r) for r in ngram_join._sieve(pairs, scan, like).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert links == {(1, 2), (1, 4), (2, 4)}
    assert links <= kept
    assert not kept & {(1, 3), (1, 5), (2, 3), (2, 5), (3, 4), (3, 5), (4, 5)}


def _strays():
    """A text, copies that link to it, and copies with about as many edits as are too many, each its own."""
    rand, base = random.Random(8), odd.prose(12, 150, 3000).split()
    texts = [" ".join(base)]
    for i in range(120):
        copy = list(base)
        for place in rand.sample(range(4, 146), 2 if i < 60 else 6):
            copy[place] = f"e{i}x{place}"
        texts.append(" ".join(copy))
    return texts


def _any_order(scan):
    """In place of the frequency table, which only steers: shingles are ordered by hash."""
    return np.zeros(ngram_join.CELLS, np.uint8)


def _joined_by_token(frame):
    """Rows that the joins on a shingle make."""
    frame.collect()
    rows, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name and "token" in node.leftKeys().toString():
            rows += node.metrics().apply("numOutputRows").value()
    return rows


def test_strays_of_one_hub_are_not_paired(spark, monkeypatch):
    """What all have from their hub pairs no strays: nothing that one of them has and the hub lacks is in another."""
    rows, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "frequency_table", _any_order)
    monkeypatch.setattr(ngram_join, "written", lambda frame, name: [name == "ngram-pairs" and rows.append(_joined_by_token(frame)), write(frame, name)][1])
    texts = list(enumerate(_strays()))
    assert got(spark, texts) == expected(texts)
    assert rows[0] < 5000  # 81,163 when they met by all they share


@pytest.mark.parametrize("crowd", [2, 32])
def test_links_by_what_the_hub_lacks_and_by_parts_of_it(spark, monkeypatch, crowd):
    """Strays that link to each other by edits they share, and pieces of the hub that link to each other but not to it."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "frequency_table", _any_order)
    rand, texts = random.Random(9), _strays()
    for text in texts[61:85]:
        copy = text.split()
        copy[rand.randrange(150)] = f"f{rand.randrange(9)}"
        texts.append(" ".join(copy))
    base = texts[0].split()
    texts += [" ".join(base[i : i + size]) for i, size in zip(range(0, 50, 3), [105, 112, 96] * 6, strict=False)]
    passage = odd.prose(13, 45, 3000)
    for i in range(40):
        at = rand.randrange(20, 100)
        texts.append(" ".join([*base[:at], passage, *base[at + rand.choice([5, 20, 45]) :]]) + f" g{i // 3}")
    rows = list(enumerate(texts))
    rand.shuffle(rows)
    assert got(spark, rows) == expected(rows)


def test_prefixes_of_what_the_hub_lacks_share_one():
    """Sets that link, where one has too little of the hub, share a shingle of their prefixes, in any common order."""
    like, rng, met = ngram_join.Similarity(), np.random.default_rng(3), 0
    frequent = rng.integers(0, 12, ngram_join.CELLS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(8, 90))
        hub, x = _set(rng, n), _set(rng, n)
        x = np.union1d(x[: int(n * rng.uniform(0.1, 0.9))], hub[: int(n * rng.uniform(0, 0.9))])
        y = np.union1d(rng.choice(x, int(len(x) * rng.uniform(0.7, 1)), replace=False), _set(rng, int(n * 0.1)))
        both, total = len(np.intersect1d(x, y)), len(x) + len(y)
        of_hub = min(len(np.intersect1d(x, hub)), len(np.intersect1d(y, hub)))
        if 100 * both >= 75 * (total - both) and 175 * of_hub < 75 * total:
            met += 1
            assert len(np.intersect1d(*(ngram_join.own_prefix(np.setdiff1d(s, hub), len(s), frequent, like) for s in (x, y))))
    assert met > 50
