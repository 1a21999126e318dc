"""Operators that answer for each row: sharding, mixing, decontamination, language, quality, fingerprints, token counts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from musterline.llm import decontaminate, fingerprints, language, mixing, quality, sharding, token_counts
from pyspark.sql import functions as F
from tests.llm import odd
from tests.llm.test_ngram_join import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# sharding


def bits(doc_id, text):
    joined = f"{'' if doc_id is None else doc_id}|{text or ''}".encode()
    return f"{int(hashlib.md5(joined).hexdigest()[:15], 16):060b}"


def split(rows, limit, prefix=""):
    """{prefix: rows} by splitting what is too large."""
    if not rows:
        return {}
    if sum(n for _, n in rows) <= limit or len(prefix) == 60:
        return {prefix: rows}
    return {k: v for b in "01" for k, v in split([r for r in rows if r[0][len(prefix)] == b], limit, prefix + b).items()}


@pytest.mark.parametrize("limit", [500, 2000, 10**9])
def test_shards_equal_splitting(spark, limit):
    rows = odd.rows()
    sized = [(bits(r[0], r[1]), len((r[1] or "").encode())) for r in rows]
    want = Counter(p for p, own in split(sized, limit).items() for _ in own)
    docs = odd.clashing(odd.frame(spark))
    found = sharding.shards(docs, limit)
    assert set(docs.columns) <= set(found.columns) and len(set(found.columns)) == len(found.columns)
    got = found.select("doc_id", "text", *sharding.NAMES).collect()
    assert Counter(r["shard"] for r in got) == want
    assert all(bits(r["doc_id"], r["text"]).startswith(r["shard"]) for r in got)
    files = defaultdict(list)
    for r in got:
        assert r["bytes"] == len((r["text"] or "").encode()) and r["oversized"] == (r["bytes"] > limit)
        files[r["shard"], r["page"]].append(r["bytes"])
    assert all(sum(x) <= limit or len(x) == 1 for x in files.values())


def test_many_equal_rows_go_to_pages(spark):
    docs = spark.range(300, numPartitions=4).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 10).alias("text"))
    files = Counter((r["shard"], r["page"]) for r in sharding.shards(docs, 45).collect())
    assert sum(files.values()) == 300 and max(files.values()) <= 4 and len({s for s, _ in files}) == 1


def test_no_shards_of_nothing(spark):
    assert sharding.shards(odd.empty(spark), 10).collect() == []


# mixing


def test_mix_of_odd_rows(spark):
    docs = odd.clashing(odd.frame(spark))
    mix = mixing.mix(docs, F.array("source"))
    rows = mix.documents.select("doc_id", "text", "source", "size", "taken").collect()
    assert len(rows) == len(odd.rows())
    sources = {r["source"]: r for r in mix.sources.collect()}
    taken = Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(sources, key=lambda s: (s is None, s)) == ["", "a", "b", "c", "d", "é", None]
    for s, r in sources.items():
        assert abs(taken[s] - r["target"]) < 3
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5), F.array("source")).documents.select("doc_id", "text", "source", "size", "taken").collect()), key=repr)


def target_of(spark, sizes, total, most=2, weights=(5, 2, 1)):
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r["source"]: r["target"] for r in mixing.targets(sources, mixing.cycle(weights), total, most).collect()}


def shared_out(sizes, total, most=2, weights=(5, 2, 1)):
    """Targets by sharing again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest, out = total, set(sizes), {}
    while rest:
        unit = left / sum(weight[s] for s in rest)
        full = {s for s in rest if weight[s] * unit > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * unit for s in rest}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        rest -= full
    return out


def test_targets_share_the_excess(spark):
    got = target_of(spark, {"a": 10, "b": 100, "c": 100}, 315.0)
    assert got["a"] == 20 and got["b"] + got["c"] == pytest.approx(295) and got["b"] == pytest.approx(295 * 2 / 3)
    rand = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        sizes = {("s" + str(i) if i else None): int(rand.integers(0, 5000)) for i in range(n)}
        total = 1.5 * sum(sizes.values())
        assert target_of(spark, sizes, total) == pytest.approx(shared_out(sizes, total))


def test_sources_without_number(spark):
    """More sources than the driver's network may have patterns: none of them overlap, so none gets there."""
    docs = spark.range(1_200_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    mix = mixing.mix(docs, F.array("source"))
    assert mixing.PATTERNS < 1_200_000
    row = mix.documents.agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most")).first()
    want = shared_out({str(i): 2 for i in range(6)}, 18.0)  # any three sources are like any other three
    assert (row["n"], row["most"]) == (1_200_000, 4)
    assert row["taken"] == sum(int(x) for x in want.values()) * 200_000
    assert mix.sources.agg(F.sum("target")).first()[0] == pytest.approx(3_600_000)


def least_cost(sizes, members, quotas, most):
    """Largest flow and its least cost by trying everything."""
    import itertools

    arcs = [(p, s) for p in sizes for s in members[p]]
    best = (0, 0)
    for words in itertools.product(*(range(min(quotas[s], most * sizes[p]) + 1) for p, s in arcs)):
        given, got = Counter(), Counter()
        for (p, s), w in zip(arcs, words, strict=True):
            given[p] += w
            got[s] += w
        if all(given[p] <= most * sizes[p] for p in sizes) and all(got[s] <= quotas[s] for s in got):
            cost = sum(2 * (i // sizes[p]) + 1 for p in sizes for i in range(given[p]))
            best = max(best, (sum(words), -cost))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_largest_and_cheapest(seed):
    rand = np.random.default_rng(seed)
    sizes = {p: int(rand.integers(1, 4)) for p in "pqr"}
    members = {p: sorted(rand.choice(["x", "y", "z"], int(rand.integers(1, 3)), replace=False).tolist()) for p in sizes}
    quotas = {s: int(rand.integers(0, 6)) for s in "xyz"}
    flow = mixing.flow(sizes, members, quotas, 2)
    given = Counter()
    for (p, _), w in flow.items():
        given[p] += w
    cost = sum(2 * (i // sizes[p]) + 1 for p in sizes for i in range(given[p]))
    assert (sum(flow.values()), -cost) == least_cost(sizes, members, quotas, 2)


def test_overlapping_sources(spark):
    rows = [(i, odd.prose(i, 10), [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    mix = mixing.mix(docs, F.col("of"), total=0.5)
    assert mix.sources.agg(F.sum("target")).first()[0] == pytest.approx(200)
    assert mix.documents.agg(F.sum("taken")).first()[0] == mix.routes.agg(F.sum("words")).first()[0]
    assert mix.documents.where("size(of) = 0 and taken > 0").count() == 0


def test_mix_of_nothing(spark):
    assert mixing.mix(odd.empty(spark), F.array("source")).documents.collect() == []


# decontamination


def test_contained_items(spark):
    rows = odd.rows()
    items = [(1, odd.prose(2, 60, 5000)), (2, " ".join(odd.prose(5, 30_000, 900).split()[20_000:20_020])), (3, None), (4, ""), (5, "One TWO"), (6, odd.prose(900, 40, 5000)), (7, odd.prose(1, 120)), (None, odd.prose(3, 100)), (8, " ".join(odd.prose(3, 100).split()[:7] + ["other"] * 2))]
    want = Counter()
    for doc_id, text, *_ in rows:
        for item_id, item in items:
            a, b = shingles(item), shingles(text)
            if a and 100 * len(a & b) >= 75 * len(a):
                want[doc_id, item_id, len(a), len(a & b)] += 1
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("span", F.lit(1)).withColumn("keys", F.lit("k"))
    got = decontaminate.contained(odd.clashing(odd.frame(spark)), table)
    assert Counter(tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_found").collect()) == want


def test_items_held_in_scattered_pieces(spark):
    """Three quarters of an item and more, in three pieces far apart in long documents: found as when compared one by one."""
    items = [(i, odd.prose(5000 + i, 60, 10**6)) for i in range(60)]
    rows = []
    for i, text in items:
        w = text.split()
        pieces = [" ".join(w[a : a + 20]) for a in (40, 0, 20)]
        rows.append((i, " ".join(x for k, piece in enumerate(pieces) for x in (odd.prose(9000 + 3 * i + k, 700, 10**6), piece))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {(i, i) for i, text in items if 100 * len(shingles(text) & shingles(rows[i][1])) >= 75 * len(shingles(text))}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) == 60 and got <= want and len(got) >= 0.99 * len(want)


def test_items_of_few_words_inside_long_texts(spark):
    texts = [(1, odd.prose(1, 900) + " Seldom met " + odd.prose(2, 900)), (2, "seldom met"), (3, "seldom\nMET twice"), (4, "met seldom"), (5, "a b c d"), (6, "x a b c d e a b"), (None, "seldom"), (7, None)]
    items = [(1, "seldom met"), (2, "A b c d"), (3, "met"), (4, "b c d e a"), (5, "not here")]
    got = decontaminate.contained(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(1, 1), (2, 1), (3, 1), (5, 2), (6, 2), (1, 3), (2, 3), (3, 3), (4, 3), (6, 4)}
    assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_found").collect()) == sorted((d, i, 1, 1) for d, i in want)


def test_nothing_contained(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(odd.frame(spark), items).collect() == []
    assert decontaminate.contained(odd.empty(spark), items).collect() == []


def test_all_items_in_long_texts_are_found(spark):
    """Recall of the signature search against an exact scan, items of all sizes at random places."""
    rand = np.random.default_rng(3)
    long = [odd.prose(i, 3000, 10**6).split() for i in range(20)]
    items = []
    for i in range(300):
        words, n = long[i % 20], int(rand.integers(5, 120))
        at = int(rand.integers(0, 3000 - n))
        items.append((i, " ".join(words[at : at + n])))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(long)], "doc_id long, text string")
    got = decontaminate.contained(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["item_id"] % 20, r["item_id"]) for r in got.collect()} == {(i % 20, i) for i, _ in items}
    assert got.count() == 300


# language


def test_language_of_odd_rows(spark):
    english = [(i, "the cat and the dog were with the bird in this house", "en") for i in range(20)]
    german = [(50 + i, "der hund und die katze waren nicht in diesem schönen haus", "de") for i in range(20)]
    model = language.learn(spark.createDataFrame([*english, *german, (99, None, "fr"), (98, "ohne", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    predict = language.predictor(spark, model)
    texts = {"the dog": "en", "die Katze": "de", "whither": "en", "schönste": "de", None: "und", "": "und", "123 !?": "und", "the " * 50_000: "en"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in docs.select("text", predict(F.col("text")).alias("p")).collect():
        assert r["p"]["lang_pred"] == texts[r["text"]], r
        assert 0 <= r["p"]["score"] <= 1 and (r["p"]["score"] > 0.5 or texts[r["text"]] == "und")
    got = odd.clashing(odd.frame(spark)).select(predict(F.col("text")).alias("p")).collect()
    assert len(got) == len(odd.rows()) and {r["p"]["lang_pred"] for r in got} <= {"de", "en", "und"}


def test_nothing_learnt(spark):
    model = language.learn(odd.empty(spark))
    assert {tuple(r[0]) for r in odd.frame(spark).select(language.predictor(spark, model)(F.col("text"))).collect()} == {("und", 0.0)}


def test_grams_stay_within_words():
    (found,) = language.words(["ab c", "äb"])
    for n, want in ((1, 5), (2, 8), (3, 5), (4, 2)):
        owner, h = language.grams(found, np.arange(len(found.hash)), n)
        assert len(h) == want and set(owner.tolist()) <= {0, 1, 2}


def spelt(seed, n):
    """n distinct words of seven letters that say nothing of a language."""
    rand, seen = np.random.default_rng(seed), {}
    while len(seen) < n:
        seen |= dict.fromkeys("".join(map(chr, x)) for x in rand.integers(97, 123, (n, 7)))
    return list(seen)[:n]


def language_sums(counts, text):
    """Sums by language from counts {length: {lang: Counter}}; lengths 4 to 1 for words never seen."""
    langs = sorted({x for by in counts.values() for x in by})
    size = {n: len(set().union(*by.values())) for n, by in counts.items()}
    whole = {n: {x: sum(by[x].values()) + 0.5 * (size[n] + 1) for x in langs} for n, by in counts.items()}
    out = np.zeros(len(langs))
    for word in text.split():
        for n in (0, 4, 3, 2, 1):
            parts = [p for p in language_parts(word, n) if any(p in counts[n][x] for x in langs)]
            if parts:
                out += np.mean([[np.log((counts[n][x][p] + 0.5) / whole[n][x]) for x in langs] for p in parts], axis=0)
                break
    return langs, out


def language_parts(word, n):
    if n == 0:
        return [word]
    line = word if n == 1 else f" {word} "
    return [line[i : i + n] for i in range(len(line) - n + 1)]


def test_language_of_more_entries_than_tasks_hold(spark):
    known, other = spelt(1, 4000), spelt(2, 300)
    learnt = [(i, " ".join(known[40 * i : 40 * i + 40] * (1 + i % 3)), "de en fr".split()[i % 3]) for i in range(100)]
    asked = [(100 + i, " ".join([*other[10 * i : 10 * i + 10], known[77 * i], "zz" * (i % 3)]), None) for i in range(30)]
    docs = spark.createDataFrame([*learnt, *asked, asked[0], (None, None, None), (None, "12 !", None), (None, "ß ñ", None)], "doc_id long, text string, lang string").repartition(3)
    counts = {n: {x: Counter() for x in ("de", "en", "fr")} for n in range(5)}
    for _, text, lang in learnt:
        for word in text.split():
            for n in counts:
                counts[n][lang].update(language_parts(word, n))
    model = language.learn(docs, 1000)
    assert model.partial == {0, 3, 4} and all(len(t.hashes) <= 1000 for t in model.tables.values())
    with pytest.raises(ValueError):
        language.predictor(spark, model)
    got = language.identify(docs.withColumn("copy", F.col("text")), model).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "lang", "copy", "p"}
    assert len({tuple(r["p"]) for r in got if r["doc_id"] == 100}) == 1
    for r in got:
        if not re.search(r"[^\W\d_]", r["copy"] or ""):
            assert tuple(r["p"]) == ("und", 0.0)
            continue
        langs, sums = language_sums(counts, r["copy"])
        assert r["p"]["lang_pred"] == langs[int(sums.argmax())], r
        assert r["p"]["score"] == pytest.approx(1 / np.exp(sums - sums.max()).sum(), abs=1e-3)
    whole = {r["copy"]: r["p"] for r in language.identify(docs.withColumn("copy", F.col("text")), language.learn(docs)).collect()}
    assert all(whole[r["copy"]]["lang_pred"] == r["p"]["lang_pred"] and whole[r["copy"]]["score"] == pytest.approx(r["p"]["score"], abs=1e-4) for r in got)


def test_language_by_words_seen_once(spark, tmp_path):
    from musterline.llm import queries

    known = spelt(3, 240_000)
    out = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 == 1]
    learnt = [i for i in range(2000) if i not in set(out)][:600]
    rows = [(i, " ".join(known[400 * k : 400 * k + 400]), f"l{k % 4}", None, None) for k, i in enumerate(learnt)]
    rows += [(i, known[400 * k], None, f"l{k % 4}", None) for k, i in enumerate(out[:500])]
    spark.createDataFrame(rows, odd.SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: r[3] for r in rows if r[3]}
    got = queries.op7_language(spark, str(tmp_path)).where("held_out").collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == want


def test_language_held_out(spark, data_dir):
    from musterline.llm import queries

    got = queries.op7_language(spark, data_dir)
    lang = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "lang")
    right, n = got.join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.95


# quality


def test_quality_held_out(spark, data_dir):
    from musterline.llm import queries

    got = queries.op2_quality(spark, data_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{data_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    right, n = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.95


def small_model(rand):
    return quality.fit(rand.normal(size=(30, quality.WIDTH)), np.array([0, 4, 5, 20]), np.array([1.0, 0.0, 1.0, 0.0]), epochs=1)


def by_loops(w, bag):
    """Score of one bag of passages, number by number."""
    import math

    encoded, raw = [], []
    for x in bag:
        h = [math.tanh(w["encode0"][j] + sum((x[i] - w["mean"][i]) / w["spread"][i] * w["encode"][i][j] for i in range(len(x)))) for j in range(len(w["encode0"]))]
        look = [math.tanh(w["look0"][j] + sum(h[i] * w["look"][i][j] for i in range(len(h)))) for j in range(len(w["look0"]))]
        gate = [1 / (1 + math.exp(-w["gate0"][j] - sum(h[i] * w["gate"][i][j] for i in range(len(h))))) for j in range(len(w["gate0"]))]
        encoded.append(h)
        raw.append(sum(a * b * c for a, b, c in zip(look, gate, w["weigh"])))
    weight = [math.exp(a) / sum(math.exp(b) for b in raw) for a in raw]
    z = [sum(weight[k] * encoded[k][j] for k in range(len(bag))) for j in range(len(encoded[0]))]
    return 1 / (1 + math.exp(-w["score0"] - sum(a * b for a, b in zip(z, w["score"]))))


def test_forward_pass_equals_loops():
    rand = np.random.default_rng(5)
    model = small_model(rand)
    x, bags = rand.normal(size=(11, quality.WIDTH)), [0, 1, 4, 10]
    got = model.forward(x, np.array(bags))["p"]
    for k, (a, b) in enumerate(zip(bags, [*bags[1:], 11])):
        assert got[k] == pytest.approx(by_loops(model.weights, x[a:b].tolist()), rel=1e-9)


def test_gradient_equals_differences():
    rand = np.random.default_rng(6)
    model = small_model(rand)
    x, bags, labels = rand.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, bags)["p"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    model.weights = {k: np.array(w) for k, w in model.weights.items()}
    for name, slope in model.gradient(x, bags, labels).items():
        flat, told = model.weights[name].reshape(-1), np.asarray(slope).reshape(-1)
        for i in rand.choice(len(flat), min(len(flat), 6), replace=False):
            at, step = flat[i], 1e-6
            flat[i] = at + step
            up = loss()
            flat[i] = at - step
            down = loss()
            flat[i] = at
            assert told[i] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-8), name


def test_long_labelled_texts_take_part_in_fitting(spark):
    """Bad texts are all longer than what is drawn of a text; without them there would be one label."""
    good = [(i, odd.prose(i, 200), 1.0) for i in range(12)]
    bad = [(100 + i, "!! 7 " * (64 * 40), 0.0) for i in range(12)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, label double")
    model = quality.learn(rows, rows.select("doc_id", "label"), passages=20)
    scored = rows.select("label", quality.scorer(spark, model)(F.col("text")).alias("score")).collect()
    assert all((r["score"] > 0.5) == (r["label"] == 1.0) for r in scored)


def test_quality_of_odd_rows(spark):
    docs = odd.frame(spark)
    labels = spark.createDataFrame([(1, 1.0), (13, 0.0), (13, 0.0), (12, 1.0), (15, 0.0), (None, 1.0), (10, None), (500, 1.0)], "doc_id long, label double")
    model = quality.learn(docs, labels)
    rows = odd.clashing(docs).withColumn("score", quality.scorer(spark, model)(F.col("text"))).select("text", "score").collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({round(r["score"], 9) for r in rows if not (r["text"] or "").split()}) == 1
    assert quality.learn(docs, labels.where("false")) is None and quality.learn(odd.empty(spark), labels) is None
    assert {r[0] for r in docs.select(quality.scorer(spark, None)(F.col("text"))).collect()} == {0.5}


def test_one_bad_passage_decides(spark):
    """Labels are of whole texts, yet the attention finds the passage they come from."""
    good = [(i, odd.prose(i, 400, 300)) for i in range(120)]
    bad = [(200 + i, odd.prose(i, 250, 300) + " " + " ".join(w.upper() + "!!" for w in odd.prose(i + 1, 70, 300).split()) + " " + odd.prose(i + 2, 150, 300)) for i in range(120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i < 200)) for i, _ in good + bad if i % 2], "doc_id long, label double")
    model = quality.learn(docs, labels)
    rows = docs.where("doc_id % 2 = 0").select("doc_id", quality.scorer(spark, model)(F.col("text")).alias("s")).collect()
    assert np.mean([(r["s"] > 0.5) == (r["doc_id"] < 200) for r in rows]) > 0.95


# fingerprints


def phrases(text):
    seen, at = set(), ""
    for ch in text:
        at += ch
        if at not in seen:
            seen.add(at)
            at = ""
    return seen


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abababab", "é漢字é漢字é", odd.prose(1, 200), "be " * 300])
def test_phrases(text):
    seen: set[str] = set()
    ends = fingerprints.parse(text, seen, 0, len(text))
    assert seen == phrases(text)
    assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == list(dict.fromkeys(text[a:b] for a, b in zip([0, *ends], ends, strict=False)))


def test_fingerprints_of_odd_rows(spark):
    rows = [(r[0], r[1] or "") for r in odd.rows()]
    got = fingerprints.compare_edited(odd.clashing(odd.frame(spark, 5))).collect()
    assert len(got) == len(rows)
    of = lambda t: fingerprints.signature(t, fingerprints.parse(t, set(), 0, len(t)))
    prints = {of(t).tobytes().hex() for _, t in rows}
    assert {r["fingerprint"] for r in got} == prints
    texts = {of(t).tobytes().hex(): t for _, t in rows}
    ids = [i for i, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)]
    assert len({i for i in ids if i is not None}) == 17
    single = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 16, 17)}
    for doc_id, next_id in zip(ids, ids[1:], strict=False):
        if doc_id in single and next_id in single:
            own, following = dict(rows)[doc_id], dict(rows)[next_id]
            r = single[doc_id]
            edited = fingerprints.edited(own, following)
            assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["edited_fingerprint"] == of(edited).tobytes().hex()
            assert r["near_edited"] == fingerprints.likeness(of(own), of(edited)) and r["near_next"] == fingerprints.likeness(of(own), of(following))
    assert all(texts[r["fingerprint"]] is not None for r in got)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_fingerprints_of_few(spark, n):
    docs = spark.createDataFrame([(i, odd.prose(i, 50)) for i in range(n)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs).collect()}
    assert len(got) == n
    for i, r in got.items():
        edited = fingerprints.edited(odd.prose(i, 50), odd.prose((i - 1) % n, 50))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


# token counts


def test_histogram(spark):
    docs = odd.clashing(odd.frame(spark))
    lengths = [r[0] for r in docs.select(token_counts.lengths()(F.col("text"))).collect()]
    assert lengths.count(0) == 3 and max(lengths) > 30_000
    sums = token_counts.histogram(docs.select(token_counts.lengths()(F.col("text")).alias("length")))
    for r in sums.collect():
        n = r["length"]
        assert r["n_docs"] == lengths.count(n) and r["n_tokens"] == n * lengths.count(n)
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert r["docs_share"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in token_counts.at_limits(sums, [0, 1, 100, 10**6]).collect():
        assert r["docs_within"] == sum(x <= r["limit"] for x in lengths)
        assert r["truncated_tokens"] == sum(min(x, r["limit"]) for x in lengths)
    ordered = sorted(lengths)
    for r in token_counts.quantiles(sums, [0.25, 0.5, 1.0]).collect():
        assert r["length"] == ordered[int(np.ceil(r["share"] * len(ordered))) - 1]


def test_lengths_round_trip():
    encoding = token_counts._encoding(token_counts.Tokenizer())
    for text in ("plain words", "é漢字 \n\t x", "<|endoftext|>"):
        assert encoding.decode(encoding.encode_ordinary(text)) == text


def test_histogram_of_nothing(spark):
    assert token_counts.histogram(odd.empty(spark).select(F.length("text").cast("long").alias("length"))).collect() == []
