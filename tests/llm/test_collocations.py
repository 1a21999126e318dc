"""Count transducers against dictionaries, collocations against counting in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from musterline.llm import collocations
from musterline.llm.automata import Transducer, union
from musterline.llm.collocations import Rule
from musterline.llm.queries import _RULE
from pyspark.sql import functions as F
from tests.llm import odd

counted = st.dictionaries(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4).map(tuple), st.integers(1, 10**12), max_size=30)


def automaton(counts):
    return Transducer.unpack(*Transducer.build(sorted(counts.items())).pack())


@settings(max_examples=200, deadline=None)
@given(st.lists(counted, max_size=4), st.integers(0, 2 * 10**12), counted)
def test_union_adds_and_composition_looks_up(parts, least, asked):
    total = Counter()
    for part in parts:
        assert list(automaton(part).items()) == sorted(part.items())
        total.update(part)
    want = sorted((k, n) for k, n in total.items() if n >= least)
    whole = union(map(automaton, parts), least)
    assert list(whole.items()) == want
    questions = Transducer.build(sorted((k, 0) for k in asked))
    assert list(whole.compose(questions)) == [x for x in want if x[0] in asked]


def test_equal_endings_are_one_state():
    tail = [("x",), ("x", "y"), ("x", "y", "z")]
    counts = {(a, *t): 7 for a in "abcdefgh" for t in tail}
    whole = automaton(counts)
    assert len(whole.arcs) == 5  # the start, and one state after each of four labels
    assert list(whole.items()) == sorted(counts.items())


def brute(rows, rule):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, rule.longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= rule.least}

        def inside(p, q):
            return len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

        found = []
        for p, a in cand.items():
            if any(b >= a and inside(p, q) for q, b in cand.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[: rule.top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def ours(docs, rule):
    return sorted(tuple(r) for r in collocations.collocations(docs, rule).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts():
    rand = random.Random(5)
    words = ["the", "The", "of", "état", "ß", "日本", "x", "new", "york", " ", "a"]
    weight = [9, 4, 5, 3, 2, 2, 3, 4, 4, 1, 3]
    out = []
    for i in range(120):
        w = rand.choices(words, weight, k=rand.randrange(60))
        out.append(("".join(x + rand.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "! "]) for x in w), rand.choice(["en", "en", "fr", None])))
    return out + [(None, "en"), ("", "fr"), (" .,\n", "xx"), ("new york new york new york", "en"), ("new york " * 50, "fr"), ("the " * 3000, "en")]


@pytest.mark.parametrize("rule", [Rule(5, 3, 2000), Rule(3, 8, 7), Rule(2, 1, 50)])
def test_equals_counting(spark, rule):
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert ours(docs, rule) == brute(rows, rule)


def test_many_ranges(spark, monkeypatch):
    """Every few prefixes a range of their own, so first words span ranges: the same counts."""
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    rule = Rule(4, 5, 100)
    monkeypatch.setattr(collocations, "PER_RANGE", 3)
    counts = collocations.count(docs, rule)
    assert len(counts.bounds.value) > 5
    assert counts.transducers.groupBy("lang").count().agg(F.max("count")).first()[0] > 5
    assert ours(docs, rule) == brute(rows, rule)


def test_shards_of_a_few_words(monkeypatch):
    """What a task makes of its rows does not depend on how often it stops to build."""
    column = pa.record_batch([pa.array([r[0] or "" for r in texts()]), pa.array([r[1] or "und" for r in texts()])], names=["text", "lang"])
    batches = [column.slice(i, 9) for i in range(0, column.num_rows, 9)]
    found = []
    for size in (10, 100, 10**9):
        monkeypatch.setattr(collocations, "BLOCK", size)
        monkeypatch.setattr(collocations, "KEYS", size)
        total = Counter()
        for batch in collocations._count(iter(batches)):
            for k, key, lang, n in zip(*(c.to_pylist() for c in batch.columns)):
                total[k, key, lang] += n
        found.append(total)
    # Languages meet their words in the order of rows, whatever the cut; pairs never cross texts.
    assert found[0] == found[1] == found[2]


def test_odd_rows_and_no_rows(spark):
    rule = Rule(5, 2, 500)
    assert ours(odd.clashing(odd.frame(spark)), rule) == brute([(r[1], r[2]) for r in odd.rows()], rule)
    assert ours(odd.empty(spark), rule) == []


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r both pass 2**64."""
    docs = spark.range(1).select(F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    assert ours(docs, Rule(2, 1, 9)) == [("en", 1, "a b", 1, 1, 1, 2, 2000)]
    big = {"a": 3 * 10**15, "n": 9 * 10**17, "l": 5 * 10**15 + 7, "r": 4 * 10**15 + 1}
    frame = spark.createDataFrame([big], "a long, n long, l long, r long")
    score = frame.select(F.expr(collocations.SCORE)).first()[0]
    assert score == 1000 * big["a"] * big["n"] // (big["l"] * big["r"])


def test_words_do_not_cross_texts_or_blocks():
    data, s, e, h, fresh = collocations.piece_words(pa.array(["one two", "", None, "three. four"]))
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == ["one", "two", "three", "four"]
    assert fresh.tolist() == [True, False, True, True]
    long = "lorem ipsum " * 200_000
    _, s, _, h, fresh = collocations.piece_words(pa.array([long]))
    assert len(s) == 400_000 and len(np.unique(h)) == 2 and fresh.sum() == 1


def test_query_rule():
    assert (_RULE.longest, _RULE.least, _RULE.top) == (5, 100, 2000)


def test_every_triple_is_counted_with_the_pairs():
    """Rows of the counting pass follow the words: five times the texts make five times the rows, whatever they make frequent."""
    table = pa.record_batch([pa.array([r[0] or "" for r in texts()]), pa.array([r[1] or "und" for r in texts()])], names=["text", "lang"])
    want = {k: Counter() for k in (1, 2, 3)}
    for text, lang in zip(*(c.to_pylist() for c in table.columns)):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09]+", piece)]
            for k in want:
                want[k].update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))

    def rows(batches):
        return [r for batch in collocations._count(iter(batches)) for r in zip(*(c.to_pylist() for c in batch.columns)) if r[0]]

    once = rows([table])
    for k, counts in want.items():
        assert sorted(n for size, _, _, n in once if size == k) == sorted(counts.values())
    assert len([r for _ in range(5) for r in rows([table])]) == 5 * len(once)
    short = pa.record_batch([pa.array(["", "a", "a b", "a. b c"]), pa.array(["en"] * 4)], names=["text", "lang"])
    for i in range(4):
        assert not [r for r in rows([short.slice(i, 1)]) if r[0] == 3]
