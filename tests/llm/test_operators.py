"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from millrace.llm import bpe, chunk_dedup, exact_dedup, languages, licenses, line_quality, mixing, prob_minhash, secrets, toxicity
from millrace.llm.common import utf8

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHING = ["id", "digest", "key", "bucket", "sign", "start", "host", "line", "shard"]


def prose(rng, n, words="alpha beta gamma delta omega river stone cloud tiger paper window garden silver music north".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


def table(spark, rows):
    full = [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with internal names."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    rows = [
        (1, "same text here and more of it", "en", "src1"), (1, "same text here and more of it", "en", "src1"), (2, "same text here and more of it", "en", "src2"),
        (3, None, "en", "src1"), (4, "", "de", None), (None, "without an id", None, "src1"), (None, None, None, None), (5, "   \n\n ", "en", "src0"),
        (6, long, "en", "src0"), (7, long + " tail", "en", "src0"), (8, "ñandú 漢字 🙂 é", None, "src9"), (9, "x", "fr", ""),
    ]
    out = table(spark, rows)
    for c in CLASHING:
        out = out.withColumn(c, out["n_chars"])
    return out


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "mixture": mixing.mixture, "mix_documents": mixing.mix_documents, "secrets": secrets.secret_scan, "licenses": licenses.license_scan,
    "exact": exact_dedup.exact_duplicates, "drop_exact": exact_dedup.drop_exact_duplicates, "near": prob_minhash.near_duplicates,
    "drop_near": prob_minhash.drop_near_duplicates, "lines": line_quality.line_quality, "bpe": bpe.bpe_encode,
    "language": lambda d: languages.identify(d, languages.train(d)),
    "toxic": lambda d: toxicity.toxic_documents(d, d.sparkSession.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (7, 1, None)], LABELS)),
    "spans": chunk_dedup.repeated_spans,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, awkward, none, name):
    got = OPERATORS[name](awkward).collect()
    assert OPERATORS[name](none).count() == 0
    ids = Counter(r["doc_id"] for r in got if "doc_id" in r)
    if name in ("bpe", "language"):
        assert sum(ids.values()) == awkward.count()
    if name == "exact":
        assert {(r["doc_id"], r["duplicate_of"]) for r in got} == {(2, 1)}
    if name == "drop_exact":
        assert len(got) == 10 and ids[1] == 1 and ids[2] == 0 and ids[None] == 2
    if name == "near":
        assert {(r["doc_id"], r["duplicate_of"]) for r in got} == {(2, 1), (7, 6)}
    if name == "lines":
        assert set(ids) == {1, 2, None, 6, 7, 8, 9} and ids[1] == 2
    if name == "spans":
        assert any(r["doc_id"] == 7 and r["stop"] - r["start"] > 100_000 for r in got)


# 1 mixing


def brute_fill(budget, nodes):
    """Water-filling by rounds: (weight, cap) of each node to its part."""
    got, live = {k: 0.0 for k in nodes}, {k for k, (w, c) in nodes.items() if w > 0 and c > 0}
    left = budget
    while live and left > 1e-9:
        total = sum(nodes[k][0] for k in live)
        full = {k for k in live if got[k] + left * nodes[k][0] / total >= nodes[k][1] - 1e-12}
        if not full:
            for k in live:
                got[k] += left * nodes[k][0] / total
            break
        for k in full:
            left -= nodes[k][1] - got[k]
            got[k] = nodes[k][1]
        live -= full
        # all still live were at 0 in each round, so nothing else moves
    return got


def test_budgets_go_to_siblings_first(spark):
    leaves = [("0", "en", "src0", 100), ("0", "en", "src4", 1000), ("0", "de", "src8", 5000), ("1", "en", "src1", 9000), ("1", "fr", "src5", 20)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["epochs"] * r["tokens"] + r["rest"] for r in mixing.leaf_budgets(df, budget=0.9, max_epochs=2).collect()}
    total = 0.9 * sum(x[3] for x in leaves)
    dom = brute_fill(total, {d: (mixing.DOMAIN_WEIGHTS[d], 2.0 * sum(x[3] for x in leaves if x[0] == d)) for d in "01"})
    want = {}
    for d in dom:
        langs = {x[1] for x in leaves if x[0] == d}
        part = brute_fill(dom[d], {g: (mixing.LANGUAGE_WEIGHTS[g], 2.0 * sum(x[3] for x in leaves if x[:2] == (d, g))) for g in langs})
        for g in langs:
            want |= brute_fill(part[g], {x[2]: (mixing.SOURCE_WEIGHTS.get(x[2], 1.0), 2.0 * x[3]) for x in leaves if x[:2] == (d, g)})
    assert all(abs(got[s] - want[s]) <= 1 for s in want)


def test_mixture_takes_what_the_budgets_say(spark):
    rng = random.Random(5)
    docs = table(spark, [(i, prose(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), f"src{rng.randint(0, 5)}") for i in range(300)])
    rows = mixing.mixture(docs).collect()
    taken = Counter()
    for r in rows:
        assert 0 < r["take"] <= r["tokens"]
        taken[r["source"], r["lang"]] += r["take"]
    leaves = mixing._leaf_columns(docs, "text", "doc_id", "lang", "source").groupBy(*mixing.LEVELS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    for b in mixing.leaf_budgets(leaves).collect():
        assert taken[b["source"], b["lang"]] == b["epochs"] * b["tokens"] + b["rest"]
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


# 2 secrets


def test_secrets_held_out_and_in_text(spark):
    model = secrets.detector()
    texts, labels = secrets.labelled_samples(3000, seed=77)
    found = [model.best(t) >= model.threshold for t in texts]
    assert sum(f for f, y in zip(found, labels) if y) / 3000 > 0.97
    assert sum(f for f, y in zip(found, labels) if not y) / 3000 < 0.005
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    text = f"é {prose(random.Random(1), 50)} token = \"{key}\" camelCaseIdentifierName 2024-01-02-123456 ================================ {key}-suffix"
    got = secrets.secret_scan(table(spark, [(7, text, "en", "a")])).collect()
    assert [r["secret"] for r in got][0] == key and len(got) == 2
    raw = text.encode()
    assert all(raw[r["start"] : r["stop"]].decode() == r["secret"] for r in got)


def test_secret_segments_match_brute_force():
    model = secrets.detector()
    for s in ["the_api_key_9c8b45435718dcc700c184a7e303cdc6", "x" * 40, "abc"]:
        codes = secrets._CLASS[np.frombuffer(s.encode(), np.uint8)]
        r = model.ratios(codes)
        brute = max([0.0] + [r[i:j].sum() for i in range(len(r)) for j in range(i + 1, len(r) + 1)])
        assert abs(brute - model.best(s)) < 1e-6


def test_detector_from_a_table(spark):
    texts, labels = secrets.labelled_samples(1000, seed=9)
    model = secrets.train_on(spark.createDataFrame([*zip(texts, labels), (None, 1)], "text string, label int"))
    assert model.best("9c8b45435718dcc700c184a7e303cdc64c6a8f7f") > model.threshold


# 3 licences


def brute_statistics(sequences, tokens):
    subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    out = []
    for i in range(len(tokens)):
        n = 0
        while n <= i and tuple(tokens[i - n : i + 1]) in subs:
            n += 1
        out.append(n)
    return out


def test_matching_statistics_and_places_match_brute_force():
    rng = random.Random(2)
    sequences = [[rng.randint(0, 3) for _ in range(25)] for _ in range(4)] + [[0, 1, 2, 3]]
    machine = licenses.Automaton(sequences)
    tokens = [rng.randint(0, 4) for _ in range(400)]
    stats = machine.statistics(tokens)
    assert [n for n, _ in stats] == brute_statistics(sequences, tokens)
    for i, (n, state) in enumerate(stats):
        if n >= licenses.LEAST_MATCH:
            want = {(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == tokens[i + 1 - n : i + 1]}
            assert set(machine.ends[state]) == want


def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    text = f"words before\n{mit.replace('without restriction', 'with no restriction')}\nmore words. LICENSED under  CC BY-NC 4.0! under the terms of the"
    got = licenses.license_scan(table(spark, [(1, text, "en", "a"), (2, "nothing under the terms of the sun", "en", "a")])).orderBy("start").collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "MIT"), (1, "CC-BY-NC-4.0")]
    raw = text.encode()
    assert raw[got[0]["start"] : got[0]["stop"]].startswith(b"Permission") and raw[got[0]["start"] : got[0]["stop"]].endswith(b"IN THE SOFTWARE")
    assert got[0]["coverage"] > 0.95


# 4 exact duplicates


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.BinaryFuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert f.contains(keys).all()
        assert f.contains(rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 1e-3


def test_exact_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, f"text {rng.randint(0, 150)}", "en", "a") for i in range(400)]
    rng.shuffle(rows)
    for batches in (1, 2, 5):
        got = {(r["doc_id"], r["duplicate_of"]) for r in exact_dedup.exact_duplicates(table(spark, rows), batches=batches, shard_keys=40).collect()}
        first = {}
        for i, t, *_ in sorted(rows):
            first.setdefault(t, i)
        assert got == {(i, first[t]) for i, t, *_ in rows if first[t] != i}
    kept = exact_dedup.drop_exact_duplicates(table(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(first.values())


# 5 near duplicates


def test_signature_estimates_probability_jaccard():
    rng = random.Random(4)
    base = prose(rng, 400).split()
    for share in (0.02, 0.1, 0.3):
        other = [w if rng.random() > share else "changed" + str(rng.randint(0, 999)) for w in base]
        a, b = " ".join(base), " ".join(other)
        data, offsets = utf8(pa.array([a, b]))
        s = prob_minhash.signatures(*prob_minhash.weighted_shingles(*prob_minhash.word_hashes(data, offsets)), 2, m=2000)
        assert abs((s[0] == s[1]).mean() - prob_minhash.exact_similarity(a, b)) < 0.05


def test_near_duplicates_recall(spark):
    rng = random.Random(6)
    texts = [prose(rng, 120, [f"w{k}x" for k in range(900)]) for _ in range(60)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        words = t.split()
        for k in rng.sample(range(len(words)), 4):
            words[k] = "edited"
        rows.append((1000 + i, " ".join(words), "en", "a"))
    got = {(r["doc_id"], r["duplicate_of"]) for r in prob_minhash.near_duplicates(table(spark, rows)).collect()}
    want = {(1000 + i, i) for i in range(60) if prob_minhash.exact_similarity(texts[i], rows[60 + i][1]) >= 0.65}
    assert len(want) > 50 and len(want & got) >= 0.95 * len(want)
    assert all(a - b == 1000 for a, b in got)
    kept = prob_minhash.drop_near_duplicates(table(spark, rows))
    assert kept.count() == len(rows) - len(got)


def test_near_duplicates_recall_from_the_threshold_upward(spark):
    rng = random.Random(18)
    texts = []
    for _ in range(400):
        words = prose(rng, 120, [f"w{k}x" for k in range(900)]).split()
        other = list(words)
        for k in rng.sample(range(120), rng.randint(8, 14)):
            other[k] = f"edited{rng.randint(0, 99)}"
        texts += [" ".join(words), " ".join(other)]
    sign = prob_minhash.signatures(*prob_minhash.weighted_shingles(*prob_minhash.word_hashes(*utf8(pa.array(texts)))), len(texts))
    alike = (sign[::2] == sign[1::2]).mean(1)
    got = {(r["doc_id"], r["duplicate_of"]) for r in prob_minhash.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for low, high in ((0.5, 0.55), (0.55, 0.6)):
        want = {(2 * k + 1, 2 * k) for k in np.flatnonzero((alike >= low) & (alike < high)).tolist()}
        assert len(want) > 40 and len(want & got) >= 0.9 * len(want)


def roots(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_buckets_connect_what_all_verified_pairs_connect(spark):
    rng = np.random.default_rng(17)
    rows, want = [], []
    for bucket in range(20):
        signs, first = [rng.integers(0, 1 << 16, 150).astype("<u2")], bucket * 100
        for k in range(1, 60):  # even buckets: a chain of edits; odd ones: copies around the original, about the threshold
            other = (signs[-1] if bucket % 2 == 0 else signs[0]).copy()
            at = rng.choice(150, 30 if bucket % 2 == 0 else rng.integers(35, 90), replace=False)
            other[at] = rng.integers(0, 1 << 16, len(at))
            signs.append(other)
        rows += [(bucket, first + k, bytearray(s.tobytes())) for k, s in enumerate(signs)]
        want += [(first + i, first + j) for i in range(60) for j in range(i) if (signs[i] == signs[j]).mean() >= 0.5]
    pairs = prob_minhash._verify(spark.createDataFrame(rows, "bucket long, id long, sign binary"), 0.5).collect()
    assert {(max(p), min(p)) for p in pairs} <= set(want)
    assert roots(pairs) == roots(want)


def test_components_match_union_find(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["first"] for r in prob_minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


# 6 quality rules


def test_frequent_lines_go(spark):
    shared = "Subscribe to newsletter 12"
    rows = [(i, f"own line number {chr(97 + i)} with words\n{shared.replace('12', str(i))}\nlast {chr(97 + i)} line", "en", "h") for i in range(25)]
    rows += [(100 + i, f"{shared}\n{shared}\nx{i}", "en", "h") for i in range(3)] + [(200, shared + "\nok " * 5, "en", "other")]
    got = {r["doc_id"]: r for r in line_quality.line_quality(table(spark, rows)).collect()}
    assert set(got) == set(range(25)) | {200}
    assert all("Subscribe" not in got[i]["text"] and got[i]["n_removed"] == 1 for i in range(25)) and "Subscribe" in got[200]["text"]


# 7 BPE


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.read_ranks(bpe.TOKENIZER))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = [prose(rng, 80), "  two  spaces\n\n\ttabs ", "naïve façade 漢字仮名 🙂🙂 é", "a" * 300, "x" * 5000 + " y", "don't we'll <|endoftext|> 12345678901234567890", " ", "　  x", ""]
    texts += ["".join(chr(rng.choice([32, 10, 97, 98, 233, 0x4E2D, 0x1F600, 39])) for _ in range(200)) for _ in range(60)]
    rows = bpe.bpe_encode(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    for r in rows:
        assert r["tokens"] == other.encode_ordinary(texts[r["doc_id"]]) and r["round_trip"]
    back = bpe.bpe_decode(spark.createDataFrame([(r["doc_id"], r["tokens"]) for r in rows], "doc_id long, tokens array<int>")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts))


# 8 languages


def test_languages_held_out(spark):
    voices = {
        "en": "the and of that with this from have which there".split(), "de": "der die und nicht mit ein auch über für schön".split(),
        "fr": "les des une dans pour qui être avec très déjà".split(), "es": "los las una para que con más también señor año".split(),
        "nl": "het een van niet voor zijn maar ook wordt naar".split(), "it": "gli della una per che con più anche città perché".split(),
        "sv": "och att det som för inte med är på även".split(),
    }
    rng = random.Random(11)
    make = lambda lang, n: " ".join(rng.choice(voices[lang]) for _ in range(n))
    names = list(voices)
    train = table(spark, [(i, make(names[i % 7], 60), names[i % 7], "a") for i in range(280)])
    model = languages.train(train, sample=60)
    assert len(model.languages) == 7 and len(model.code[0]) > 6
    test = [(i, make(names[i % 7], 40), None, "a") for i in range(140)] + [(900, "der", None, "a"), (901, "1 2 3 !!", None, "a"), (902, None, None, "a")]
    got = {r["doc_id"]: r for r in languages.identify(table(spark, test), model).collect()}
    assert sum(got[i]["predicted"] == names[i % 7] for i in range(140)) >= 138
    assert got[900]["ambiguous"] and got[902]["predicted"] is None
    again = {r["doc_id"]: r["gap"] for r in languages.identify(table(spark, test[::-1]).coalesce(1), model).collect()}
    assert again == {k: r["gap"] for k, r in got.items()}


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 6, 9, 20):
        code = languages.codewords(n)
        least = min([int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)] or [1])
        assert least >= (1 if n <= 2 else 2 if n <= 6 else code.shape[1] // 5)


# 9 toxicity


def _features(texts):
    out = []
    for t in texts:
        data, offsets = utf8(pa.array([t]))
        out.append(toxicity.window_features(data, offsets)[:2])
    return out


def test_counterfactual_penalty_spares_neutral_mentions():
    rng = random.Random(12)
    texts, y = [], []
    for i in range(400):
        toxic = i % 2
        # among toxic texts a group is named far more often: a plain classifier learns the name
        group = rng.choice(["muslims", "women"]) if rng.random() < (0.9 if toxic else 0.05) else rng.choice(["people", "neighbours"])
        insult = rng.choice(["idiot", "scum", "moron"]) if toxic and rng.random() < 0.75 else ""
        texts.append(f"{prose(rng, 30)}. {prose(rng, 5)} {group} {insult} {prose(rng, 5)}. {prose(rng, 20)}")
        y.append(toxic)
    y = np.array(y)
    plain, fair = (toxicity.fit(_features(texts), y, penalty=p) for p in (0.0, 50.0))
    gap = lambda m: abs(m.weights[toxicity.term_features(["muslims", "women"])].sum(1).mean() - m.weights[toxicity.term_features(["people", "neighbours"])].sum(1).mean())
    assert gap(fair) < 0.5 * gap(plain)
    insult = fair.weights[toxicity.term_features(["idiot"])].sum()
    assert insult > 2 * abs(fair.weights[toxicity.term_features(["muslims"])].sum())


def test_toxicity_held_out(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        insult = " ".join(rng.sample("idiot scum moron loser clown".split(), 2)) if toxic else ""
        rows.append((i, f"{prose(rng, rng.randint(5, 300))} {insult} {prose(rng, rng.randint(5, 300))}", "en", "a"))
        labels.append((i, 1, int(toxic)))
    docs = table(spark, rows)
    marks = spark.createDataFrame(labels[:350], LABELS)
    got = {r["doc_id"] for r in toxicity.toxic_documents(docs, marks).collect()}
    held = range(350, 500)
    assert all((i in got) == (i % 4 == 0) for i in held)


# 10 repeated spans


def brute_chunks(raw, mean, least, most):
    """Chunk ends by the definition, byte by byte."""
    cuts, last = [], 0
    for p in range(1, len(raw) + 1):
        h = 0
        for b in raw[max(0, p - 32) : p]:
            h = (h * 2 + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
        whole = p == len(raw) or raw[p] & 0xC0 != 0x80
        if p - last > most or (p - last == most and p < len(raw)):
            end = last + most
            while raw[end : end + 1] and raw[end] & 0xC0 == 0x80:
                end -= 1
            cuts.append(end)
            last = end
        if p - last >= least and h < (1 << 32) // mean and whole:
            cuts.append(p)
            last = p
    if last < len(raw):
        cuts.append(len(raw))
    return cuts


def test_chunks_match_brute_force():
    rng = random.Random(14)
    texts = [prose(rng, 200), "", "ab", "é" * 600, "z" * 700, prose(rng, 30) + "漢字" * 100]
    data, offsets = utf8(pa.array(texts))
    got = chunk_dedup.cut_points(data, offsets)
    for t, cuts in zip(texts, got):
        raw = t.encode()
        assert [0, *cuts][-1] == len(raw) and all(raw[a:b].decode() is not None for a, b in zip([0, *cuts], cuts))
        assert cuts == brute_chunks(raw, chunk_dedup.MEAN, chunk_dedup.LEAST, chunk_dedup.MOST)


def test_repeated_passages_are_found_despite_insertions(spark):
    rng = random.Random(15)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ri") for b in ("dar", "fen", "gol", "hib", "jun", "tax", "vel", "wem")]
    passages = [prose(rng, 60, vocabulary) for _ in range(20)]
    rows = []
    for i in range(60):
        rows.append((i, f"{prose(rng, rng.randint(3, 60), vocabulary)} {passages[i % 20]} {prose(rng, rng.randint(3, 60), vocabulary)}", "en", "a"))
    clean = [(1000 + i, prose(rng, 150, [w + str(i) for w in vocabulary]), "en", "a") for i in range(20)]
    got = defaultdict(list)
    for r in chunk_dedup.repeated_spans(table(spark, rows + clean)).collect():
        got[r["doc_id"]].append(r)
    assert sum(i in got for i in range(20, 60)) >= 38 and not any(i in got for i, *_ in clean)
    for i in range(20, 60):
        text = rows[i][1].encode()
        at = text.index(passages[i % 20].encode())
        for r in got.get(i, []):
            assert at - 300 <= r["start"] and r["stop"] <= at + len(passages[i % 20]) + 300


def test_passages_just_over_50_words_are_found(spark):
    rng = random.Random(19)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ri") for b in ("dar", "fen", "gol", "hib", "jun", "tax", "vel", "wem")]
    passages = [prose(rng, 51, vocabulary) for _ in range(300)]
    rows = [(i, f"{prose(rng, rng.randint(3, 60), vocabulary)} {passages[i % 300]} {prose(rng, rng.randint(3, 60), vocabulary)}", "en", "a") for i in range(600)]
    got = {r["doc_id"] for r in chunk_dedup.repeated_spans(table(spark, rows)).collect()}
    assert not got & set(range(300)) and len(got) >= 0.98 * 300


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as corpus

    rng = random.Random(16)
    rows = [(i, prose(rng, 80, [f"v{k}" for k in range(700)]), "en", f"src{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "src1") for i in range(10)] + [(200 + i, rows[i][1] + " tail", "en", "src1") for i in range(10)] + [(300, None, None, None), (301, "", "en", "src1")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] == set(range(80)) | set(range(100, 110)) | set(range(200, 210)) and kept[1] == set(range(80)) | set(range(200, 210))
    assert kept[2] == set(range(80)) and kept[3] <= kept[2]
    out = corpus.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == kept[3] and out.where("NOT round_trip").count() == 0


def test_one_document_of_a_large_family_survives_the_pipeline(spark):
    import corpus_pipeline as corpus

    rng = random.Random(20)
    words = [f"v{k}" for k in range(700)]
    original = [prose(rng, 12, words) for _ in range(10)]
    rows = []
    for i in range(60):  # one line changed in each copy
        lines = list(original)
        lines[i % 10] = prose(rng, 12, words)
        rows.append((i, "\n".join(lines), "en", "hot"))
    footer = "All rights reserved by the owners of this site"
    rows += [(100 + i, f"{prose(rng, 40, words)}\n{footer}", "en", "hot") for i in range(30)] + [(200, footer, "en", "hot")]
    docs, kept = table(spark, rows), []
    for name, stage in corpus.STAGES[:3]:
        docs = stage(spark, docs, "")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == set(range(60)) | set(range(100, 130)) and not any(footer in t for t in kept[0].values())
    assert set(kept[2]) == {0} | set(range(100, 130)) and kept[2][0] == rows[0][1]
