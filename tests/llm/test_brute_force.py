"""Whole operators against brute-force versions, and the pipeline on awkward tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import chunk_dedup, common, exact_dedup, languages, licenses, line_quality, mixing, prob_minhash, secrets, toxicity
from millrace.llm.common import utf8

from .test_operators import CLASHING, OPERATORS, _features, brute_chunks, prose, roots, table


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_that_are_no_whole_numbers_raise(spark, name):
    docs = spark.createDataFrame([("a", "some text", "en", "src1", 9)], "doc_id string, text string, lang string, source string, n_chars long")
    if name in ("mix_documents", "drop_exact", "drop_near", "toxic"):
        with pytest.raises(TypeError):
            OPERATORS[name](docs).count()
    else:
        with pytest.raises(TypeError):
            OPERATORS[name](docs)


# 1


def test_share_of_a_weightless_leaf_goes_to_its_siblings(spark):
    leaves = spark.createDataFrame([("0", "en", "a", 100), ("0", "en", "b", 1000), ("0", "en", "c", 1000), ("0", "de", "b", 900)], "domain string, lang string, source string, tokens long")
    got = {(r["lang"], r["source"]): r["epochs"] * r["tokens"] + r["rest"] for r in mixing.leaf_budgets(leaves, budget=0.35, max_epochs=1, source_weights={"b": 0.0}, language_weights={}).collect()}
    assert got == {("en", "a"): 100, ("en", "b"): 0, ("en", "c"): 950, ("de", "b"): 0}


def test_the_last_document_of_a_prefix_is_cut(spark):
    rng = random.Random(31)
    docs = table(spark, [(i, ("\n " if i % 3 else "") + "  ".join(prose(rng, rng.randint(1, 40)).split()) + " \t", "en", f"src{i % 5}") for i in range(200)])
    want = Counter()
    for r in mixing.mixture(docs).collect():
        want[r["doc_id"], r["take"]] += 1
    got = Counter((r["doc_id"], len(r["text"].split())) for r in mixing.mix_documents(docs).collect())
    assert got == want
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in mixing.mix_documents(docs).collect())


# 2


def brute_secrets(model, raw):
    """(start, stop) by the definition: the best segment of a run, of equals the one that ends, then begins first."""
    found, at = [], 0
    inside = [secrets._CLASS[b] != 255 for b in raw] + [False]
    for i, ok in enumerate(inside):
        if ok:
            continue
        if i - at >= secrets.LEAST:
            run = raw[at:i]
            codes = secrets._CLASS[np.frombuffer(run, np.uint8)]
            ratio = model.ratios(codes)
            alnum = [chr(b).isalnum() for b in run]

            def cut(a, b, base=at):
                if b - a < secrets.LEAST:
                    return
                sums = [0.0]
                for x in ratio[a:b]:
                    sums.append(sums[-1] + x)
                best, begin, end = 0.0, 0, 0
                for e in range(len(sums)):
                    low = min(range(e + 1), key=lambda k: sums[k])
                    if sums[e] - sums[low] > best + 1e-9:
                        best, begin, end = sums[e] - sums[low], low, e
                if best < model.threshold:
                    return
                s, e = a + begin, a + end
                while alnum[s] and s > a and alnum[s - 1]:
                    s -= 1
                while alnum[e - 1] and e < b and alnum[e]:
                    e += 1
                if e - s >= secrets.LEAST:
                    found.append((base + s, base + e))
                cut(a, s)
                cut(e, b)

            cut(0, len(run))
        at = i + 1
    return sorted(found)


def test_secret_scan_matches_brute_force(spark):
    rng = random.Random(32)
    model = secrets.detector()
    keys = ["".join(rng.choices("0123456789abcdef", k=rng.choice((16, 32, 40)))) for _ in range(40)]
    glue = [" ", "_", "-", "/", "=", "\n", " é ", "key_", "-name-of-the-"]
    texts = ["".join(rng.choice(glue) + (rng.choice(keys) if rng.random() < 0.4 else prose(rng, 2).replace(" ", rng.choice("_- "))) for _ in range(12)) for _ in range(60)]
    got = defaultdict(list)
    for r in secrets.secret_scan(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect():
        got[r["doc_id"]].append((r["start"], r["stop"]))
    assert sum(map(len, got.values())) > 30
    assert {i: sorted(x) for i, x in got.items()} == {i: w for i, t in enumerate(texts) if (w := brute_secrets(model, t.encode()))}


# 3


def brute_chain_scores(matches, least_gap):
    """Best matched tokens of a chain of (stop in template, stop in text, length) ending at each, over all chains."""
    own = sorted((stop, end, n) for end, stop, n in matches)
    score = []
    for j, (stop, end, n) in enumerate(own):
        best = n
        for i in range(j):
            s, e, _ = own[i]
            new = min(n, stop - s, end - e)
            if new > 0 and stop - n - s <= least_gap:
                best = max(best, score[i] + new)
        score.append(best)
    return score


def test_license_chains_match_brute_force():
    rng = random.Random(33)
    scanner = licenses.Scanner()
    for _ in range(40):
        k = rng.randrange(len(scanner.sizes))
        matches = [(k, rng.randint(4, max(4, scanner.sizes[k])), rng.randint(4, 120), rng.randint(4, 9)) for _ in range(rng.randint(1, 25))]
        scores = brute_chain_scores([m[1:] for m in matches], licenses.MOST_GAP)
        found = scanner._chains(matches)
        enough = [s for s in scores if s >= scanner._enough(k)]
        assert max([f[0] for f in found], default=0) == max(enough, default=0)
        assert all(f[0] in enough and f[3] == k and f[1] < f[2] for f in found)


def test_versions_of_licences_are_told_apart(spark):
    names = ["GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause"]
    rows = [(i, f"File head.\n# {max(licenses.TEMPLATES[n], key=len)}\nint main", "en", "a") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["license"] for r in licenses.license_scan(table(spark, rows)).collect()}
    assert got == dict(enumerate(names))


# 4


def test_digests_of_several_texts_are_told_apart(spark):
    held = spark.createDataFrame([(7, 1, "x"), (7, 2, "y"), (7, 3, "x"), (7, 4, "y"), (8, 5, "z"), (8, 6, "z"), (8, 6, "z")], "digest long, id long, text string")
    firsts = held.groupBy("digest", "text").agg({"id": "min"}).withColumnRenamed("min(id)", "first")
    got = exact_dedup._members(held, firsts, spark.createDataFrame([(7,)], "digest long")).collect()
    assert sorted(map(tuple, got)) == [(3, 1), (4, 2), (6, 5)]


def test_shards_follow_the_larger_side(spark):
    rows = [(0, "first", "en", "a")] + [(10**12 + i, f"text {i % 900}", "en", "a") for i in range(1000)]
    got = {(r["doc_id"], r["duplicate_of"]) for r in exact_dedup.exact_duplicates(table(spark, rows), shard_keys=50).collect()}
    assert got == {(10**12 + i, 10**12 + i - 900) for i in range(900, 1000)}


# 5


def test_near_duplicates_match_all_verified_pairs(spark):
    rng = random.Random(34)
    vocabulary = [f"w{k}x" for k in range(600)]
    texts = []
    for _ in range(12):  # families of copies of copies, of exact copies and of texts about the threshold
        words = prose(rng, 100, vocabulary).split()
        for k in range(12):
            other = list(words)
            for at in rng.sample(range(100), rng.choice((0, 1, 4, 9, 12))):
                other[at] = rng.choice(vocabulary)
            texts.append(" ".join(other))
            if k % 3 == 0:
                words = other
    sign = prob_minhash.signatures(*prob_minhash.weighted_shingles(*prob_minhash.word_hashes(*utf8(pa.array(texts)))), len(texts))
    keys, short = prob_minhash.band_keys(sign), sign >> np.uint32(16)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (keys[i] == keys[j]).any() and (short[i] == short[j]).mean() >= 0.5]
    root = roots(pairs)
    want = {(x, r) for x, r in root.items() if x != r}
    sizes = Counter(root.values())
    assert len(want) > 80
    for part in (2048, 3):
        rows = prob_minhash.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), part=part).collect()
        assert {(r["doc_id"], r["duplicate_of"]) for r in rows} == want
        assert all(r["n_group"] == sizes[r["duplicate_of"]] for r in rows)


# 6


def test_documents_of_a_line_are_counted_not_texts(spark):
    rows = [(i, "The same two lines\nof boilerplate everywhere", "en", "hot") for i in range(500)] + [(1000, "The same two lines\nand a much longer line of its own here", "en", "hot"), (1001, "The same two lines", "en", None)]
    docs = table(spark, rows)
    got = sorted((r["doc_id"], r["text"]) for r in line_quality.line_quality(docs).collect())
    assert got == [(1000, "and a much longer line of its own here"), (1001, "The same two lines")]
    assert sorted((r["doc_id"], r["text"]) for r in line_quality.line_quality(docs, most=0).collect()) == got
    assert line_quality.line_quality(docs, families=True).count() == len(rows)
    nameless = table(spark, [(None, f"shared line\nown {'abcdefghijklmnopqrstuvwxyz'[i % 25]} and more", "en", "h") for i in range(100)])
    assert all("shared" not in r["text"] for r in line_quality.line_quality(nameless).collect())


# 8


def test_language_decoding_matches_brute_force(spark):
    rng = random.Random(35)
    voices = {"en": "the and of that with this", "de": "der die und nicht mit schön", "fr": "les des être pour déjà qui"}
    docs = table(spark, [(i, " ".join(rng.choice(voices[g].split()) for _ in range(30)) + " 12, 3!", g, "a") for i, g in enumerate(list(voices) * 40)])
    model = languages.train(docs, sample=30)

    def margins(text):
        low, total, n = common.folded(np.frombuffer(text.encode(), np.uint8)).tolist(), model.bias * 0, 0
        low = [1 if 48 <= b <= 57 else b for b in low]
        for size in languages.GRAMS:
            for end in range(size, len(low) + 1):
                if low[end - 1]:
                    code = int.from_bytes(bytes(low[end - size : end]), "big")
                    at = (code + size) * languages._SALT[size] % (1 << 32) >> (32 - languages.LOG_SIZE)
                    total, n = total + model.weights[at].astype(float), n + 1
        return model.bias + total / max(n, 1), n

    for r in languages.identify(docs, model).join(docs, "doc_id").collect():
        m, n = margins(r["text"])
        losses = [sum(t * math.log1p(math.exp(-x * c)) for x, c, t in zip(m, code, model.trust)) for code in model.code.tolist()]
        order = np.argsort(losses)
        gap = (losses[order[1]] - losses[order[0]]) / losses[order[1]]
        assert model.languages[order[0]] == r["predicted"] and abs(gap - r["gap"]) < 1e-4
        assert r["ambiguous"] == (r["gap"] < languages.GAP or n < languages.LEAST_GRAMS)


def test_samples_are_bounded_whatever_the_ids(spark):
    cases = [[(None, f"text number {i}", "en") for i in range(3000)], [(i % 2, "the same text", "en") for i in range(3000)], [(1, f"t {i}", "en" if i % 3 else "de") for i in range(300)]]
    for rows in cases:
        df = spark.createDataFrame(rows, "id long, text string, lang string")
        got = Counter(r["lang"] for r in common.bounded_sample(df, "lang", ["id", "text"], 120, 5).collect())
        assert got == {g: min(120, n) for g, n in Counter(r[2] for r in rows).items()}


# 9


def windows_of(texts):
    return [toxicity._distinct(f) for f, _ in _features(texts)]


def test_swap_loss_matches_explicit_swaps():
    rng = random.Random(36)
    identity = ["women", "muslims", "people", "blind", "refugees"]
    texts = [" ".join(prose(rng, 6).split() + rng.sample(identity, rng.choice((0, 1, 2, 5)))) for _ in range(40)]
    share = np.array([rng.random() for _ in texts])
    weights = np.random.default_rng(1).normal(size=1 << toxicity.LOG_SIZE)
    terms = toxicity.term_features(identity)
    score = lambda t: weights[windows_of([t])[0]].sum()
    want = 0.0
    for t, s in zip(texts, share):
        words = t.split()
        own = [w for w in identity if w in words]
        swaps = [[b if w == a else w for w in words] for a in own for b in identity if b not in words]
        want += sum(s / len(swaps) * (score(" ".join(x)) - score(t)) ** 2 for x in swaps) if swaps else 0
    assert abs(want - toxicity.counterfactual_loss(weights, terms, toxicity.swap_weights(windows_of(texts), share, terms))) < 1e-8 * want


def neutral_mentions(seed, n):
    """Toxic texts name a group more often; an insult is what makes them toxic."""
    rng, texts, y = random.Random(seed), [], []
    for i in range(n):
        toxic = i % 2
        group = rng.choice(["muslims", "women", "refugees", "gay"]) if rng.random() < (0.9 if toxic else 0.1) else rng.choice(["people", "neighbours"])
        insult = rng.choice(["idiot", "scum", "moron", "vermin"]) if toxic and rng.random() < 0.8 else ""
        texts.append(f"{prose(rng, 20)}. {prose(rng, 5)} {group} {insult} {prose(rng, 5)}. {prose(rng, 10)}")
        y.append(toxic)
    return texts, np.array(y), rng


def test_default_penalty_spares_held_out_neutral_mentions():
    texts, y, rng = neutral_mentions(37, 600)
    neutral = [f"{prose(rng, 10)} {rng.choice(['muslims', 'women', 'refugees', 'gay'])} {prose(rng, 10)}" for _ in range(300)]
    toxic = [f"{prose(rng, 10)} {rng.choice(['idiot', 'scum', 'moron', 'vermin'])} {prose(rng, 10)}" for _ in range(300)]
    plain, fair = (toxicity.fit(_features(texts), y, penalty=p) for p in (0.0, toxicity.PENALTY))
    flagged = lambda m, t: sum(m.windows(*f).max() > m.threshold for f in _features(t))
    assert flagged(plain, neutral) > 200 and flagged(fair, neutral) < 30
    assert flagged(fair, toxic) > 270


def test_the_fit_is_the_least_of_its_loss():
    texts, y, _ = neutral_mentions(38, 120)
    windows = windows_of(texts)
    share = np.full(len(y), 1 / len(y))
    terms, size = toxicity.term_features(["women", "muslims", "people"]), 1 << toxicity.LOG_SIZE
    may = np.zeros(size, bool)
    may[toxicity.term_features(["idiot", "scum", "women", "muslims", "people"])] = True

    def loss(w, b):
        margin = np.array([b + w[f].sum() for f in windows])
        out = (share * (np.logaddexp(0, margin) - y * margin)).sum() + 2.0 * toxicity.counterfactual_loss(w, terms, toxicity.swap_weights(windows, share, terms))
        return out + 0.5 * toxicity.RIDGE * (w**2).sum() + 0.5e-6 * b * b

    w, b = toxicity._fit(windows, y, share, np.zeros(size), 0.0, terms, may, 2.0)
    assert not w[~may].any()
    rng = np.random.default_rng(2)
    for _ in range(20):
        step = np.where(may, rng.normal(size=size), 0) * 1e-2
        assert loss(w + step, b + rng.normal() * 1e-2) >= loss(w, b) - 1e-9


# 10


def brute_spans(rows, least):
    """Spans of chunks that occurred before, by a dictionary of the first place of each."""
    places, first = [], {}
    for i, t in sorted(rows):
        raw, at = t.encode(), 0
        for end in brute_chunks(raw, chunk_dedup.MEAN, chunk_dedup.LEAST, chunk_dedup.MOST):
            places.append((i, at, end, raw[at:end]))
            at = end
    for i, a, b, chunk in sorted(places):
        first.setdefault(chunk, (i, a))
    out = []
    for i, a, b, chunk in sorted(places):
        if first[chunk] == (i, a):
            continue
        if out and out[-1][0] == i and out[-1][2] == a:
            out[-1] = (i, out[-1][1], b, min(out[-1][3], first[chunk][0]), out[-1][4] + 1)
        else:
            out.append((i, a, b, first[chunk][0], 1))
    return [x for x in out if x[2] - x[1] >= least]


def test_spans_match_brute_force(spark):
    rng = random.Random(39)
    passages = [prose(rng, 60) for _ in range(5)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else prose(rng, 20) for _ in range(4))) for i in range(25)] + [(90, ""), (91, passages[0])]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    want = brute_spans(rows, 60)
    for seen in (64, 2):  # hot chunks or none
        assert sorted(map(tuple, chunk_dedup.repeated_spans(docs, min_span=60, every=1, least_seen=seen * 10**6 if seen == 64 else seen).collect())) == want
    cut = {r["doc_id"]: r["text"] for r in chunk_dedup.drop_repeated_spans(docs, min_span=60).collect()}
    for i, t in rows:
        raw, out, at = t.encode(), b"", 0
        for _, a, b, *_ in [w for w in want if w[0] == i]:
            out, at = out + raw[at:a], b
        assert cut[i] == (out + raw[at:]).decode()


# the pipeline


@pytest.fixture
def corpus_dir(tmp_path):
    def make(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_pipeline_on_an_awkward_table_with_clashing_columns(spark, corpus_dir):
    import corpus_pipeline as corpus

    rng = random.Random(40)
    long = prose(rng, 30_000)
    rows = [(i, prose(rng, 60, [f"v{k}" for k in range(500)]), "en", f"src{i % 3}") for i in range(20)]
    rows += [(1, rows[1][1], "en", "src1"), (50, rows[2][1], None, None), (None, "a text without any id at all", None, "src1"), (None, None, None, None), (51, "", "en", "src1"), (52, " \n ", "en", "src1"), (53, long, "en", "src0"), (54, long + " tail", "en", "src0")]
    docs = table(spark, rows)
    for c in CLASHING + ["kept", "bad", "hash", "left", "n_lines", "copy", "cut", "loser"]:
        docs = docs.withColumn(c, docs["n_chars"])
    d = corpus_dir(docs)
    df = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus.STAGES[:-1]:
        df = stage(spark, df, d)
        assert df.columns == docs.columns, name
        kept = Counter(r["doc_id"] for r in df.select("doc_id").collect())
        if name == "quality":
            assert set(kept) == set(range(20)) | {50, None, 53, 54} and kept[1] == 2
        if name == "exact_dedup":
            assert set(kept) == set(range(20)) | {None, 53, 54} and max(kept.values()) == 1
        if name == "near_dedup":
            assert set(kept) == set(range(20)) | {None, 53}
    out = corpus.run(spark, d).collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in out) and {r["doc_id"] for r in out} <= set(kept)


def test_pipeline_on_an_empty_table(spark, corpus_dir):
    import corpus_pipeline as corpus

    assert corpus.run(spark, corpus_dir(table(spark, []))).count() == 0
