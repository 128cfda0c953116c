"""Models and features against plain versions, step by step, without the vector code of the operators."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from parchment.llm import langid, media, queries, toxicity

from .test_operators import table

SF = "/root/testdata/sf0.01"


# languages


def plain_shares(text):
    """n-gram shares by place, counted one by one."""
    raw = [32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if b <= 90 else b for b in text.encode()]
    raw = [32, *raw, 32]
    out = [0.0] * (langid.PAIRS + langid.TRIPLES)
    for a, b in zip(raw, raw[1:]):
        out[(a * 641 + b * 33) % langid.PAIRS] += 1 / (len(raw) - 1)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        out[langid.PAIRS + (a * 7919 + b * 641 + c * 33) % langid.TRIPLES] += 1 / max(1, len(raw) - 2)
    return [math.sqrt(x) for x in out]


def plain_decode(model, text):
    """Loss-weighted decoding: the codeword of least loss, its share, and whether the next one is near."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    x = [10 * v for v in plain_shares(text)] + [1.0]
    margins = [sum(float(w) * v for w, v in zip(model.weights[:, k], x) if v) for k in range(model.code.shape[1])]
    losses = [sum(math.log1p(math.exp(-b * m)) for b, m in zip(word, margins)) for word in model.code.tolist()]
    best = min(losses)
    order = sorted(losses)
    return model.langs[losses.index(best)], 1 / sum(math.exp(best - x) for x in losses), (order[1] - order[0]) / len(margins) < langid.LEAD


def test_language_query_against_plain_decoding(spark):
    docs = table("documents", "/root/testdata/sf0.001")
    model = langid.train_language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    frame = spark.createDataFrame([(int(r.doc_id), r.text) for r in docs.itertuples()] + [(-1, "123 !"), (-2, None), (-3, "é"), (-4, "ok ok")], "doc_id long, text string")
    for row, text in ((r, t) for r, t in zip(langid.identify_languages(frame, model).collect(), [r["text"] for r in frame.collect()])):
        lang, score, ambiguous = plain_decode(model, text)
        assert row["lang_pred"] == lang and row["score"] == pytest.approx(score, abs=1e-3)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        if abs(row["score"] - 0.5) > 0.2:
            assert row["ambiguous"] == ambiguous


def test_bit_classifiers_against_one_at_a_time():
    texts, langs = ["der die das und ist", "the and of is to", "el la los que y", "le les des et un", "nicht ein zu mit", "with for that on"], ["de", "en", "es", "fr", "de", "en"]
    model = langid.LanguageModel(texts, langs, steps=12)
    names = sorted(set(langs))
    x = np.array([[10 * v for v in plain_shares(t)] + [1.0] for t in texts])
    weight = [len(langs) / len(names) / langs.count(k) for k in langs]
    for bit in range(model.code.shape[1]):
        want = [int(model.code[names.index(k), bit]) for k in langs]
        w, first, second = (np.zeros(x.shape[1]) for _ in range(3))
        for t in range(1, 13):
            slope = 1e-5 * w
            for row, y, share in zip(x, want, weight):
                slope = slope - share * y / (1 + math.exp(y * float(row @ w))) * row / len(texts)
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        assert np.abs(x @ w - x @ model.weights[:, bit]).max() < 0.02 * np.abs(x @ w).max()  # 32-bit against 64-bit steps


def test_equal_losses_take_the_first_language():
    model = langid.LanguageModel(["same words"] * 2, ["aa", "bb"])
    model.weights[:] = 0
    assert model.predict("anything") == ("aa", 0.5, True)


def test_a_rare_language_is_learned(spark):
    rows = [(k, f"plain words number {k} and the rest of it", "en") for k in range(4000)] + [(10_000 + k, f"zzz qqq xxx vvv kkk jjj {k}", "xx") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_language_model(frame, rows=200)
    assert model.langs == ["en", "xx"] and model.predict("qqq vvv kkk")[0] == "xx"


# toxicity


def plain_features(text, lexicon):
    text = text or ""
    words = re.findall(r"[^\W_]+", text.lower())
    if re.search(r"[^\W\d_][@$!*#0-9.\-][^\W\d_]", text):
        for part in text.lower().split():
            if re.search(r"[^\W\d_][@$!*#0-9.\-][^\W\d_]", part):
                part = "".join(dict(zip("013457@$!", "oleastasi")).get(c, c) for c in part)
                if w := "".join(re.findall(r"[^\W_]+", part)):
                    words.append(w)

    def weight(w):
        keys = [w + "$"] + [w[:k] for k in range(3, 9) if k < len(w)]
        found = max(lexicon.weights.get(k, 0.0) for k in keys)
        if not found and not w.isalpha():
            plain = "".join(dict(zip("013457@$!", "oleastasi")).get(c, c) for c in w)
            found = lexicon.weights.get(plain + "$", 0.0) if plain != w else 0.0
        return found

    weights = [weight(w) for w in words]
    strong, you = [i for i, x in enumerate(weights) if x > 4], [i for i, w in enumerate(words) if w in toxicity.YOU]
    hits = [x for x in weights if x]
    top = sorted(hits, reverse=True)
    n, size = max(1, len(words)), max(1, len(text))
    return [
        len(strong) / n, len(hits) / n, len(strong), len(hits), sum(hits) / n, max(hits, default=0), sum(top[:5]), sum(any(abs(i - j) <= 5 for j in you) for i in strong), len({words[i] for i in strong}), len(you) / n,
        sum("A" <= c <= "Z" for c in text) / size, len(re.findall("[A-Z]{3,}", text)) / n, sum(c in "!?*#$%&" for c in text) / size, text.count("!") / size,
        len(re.findall(r"[^\W\d_][@$!*#0-9.\-][^\W\d_]", text)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(c in "0123456789" for c in text) / size, len(set(words)) / n, math.log1p(n),
    ]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train_toxicity_model(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def plain_score(model, text):
    """Down every tree, node by node, then between the knots of the calibration."""
    x, raw = plain_features(text, model.lexicon), model.trees.start
    for tree in model.trees.trees:
        at = 0
        while tree[at][0] >= 0:
            feature, cut, left, right = tree[at]
            at = left if x[feature] <= cut else right
        raw += tree[at][1]
    xs, ys = model.knots
    if raw <= xs[0] or raw >= xs[-1]:
        return float(ys[0] if raw <= xs[0] else ys[-1])
    k = max(i for i in range(len(xs) - 1) if xs[i] <= raw)
    return float(ys[k] if xs[k + 1] == xs[k] else ys[k] + (ys[k + 1] - ys[k]) * (raw - xs[k]) / (xs[k + 1] - xs[k]))


def test_toxicity_scores_against_plain_trees(spark, model):
    docs = [(int(r.doc_id), r.text) for r in table("documents", "/root/testdata/sf0.001").itertuples()] + [(-1, None), (-2, ""), (-3, "YOU st*pid 1diot!!! you you"), (-4, "x" * 5000)]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for doc_id, text in docs:
        assert got[doc_id]["score"] == pytest.approx(plain_score(model, text), abs=1e-9)
        assert got[doc_id]["predicted"] == int(got[doc_id]["score"] >= 0.5) and got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_a_lexicon_against_plain_counts():
    bags = [{"stupid", "fool"}, {"stupid", "idiots"}, {"stupid"}, {"stupid", "fool"}, {"fool", "kind"}, {"kind", "words"}, {"plain"}, {"plain", "words"}] * 3
    toxic, fold = np.array([1, 1, 1, 1, 0, 0, 0, 0] * 3), np.array([k % toxicity.FOLDS for k in range(24)])
    *parts, whole = toxicity.lexicons(bags, toxic, fold)
    for k, lexicon in enumerate([*parts, whole]):
        rows = [(b, t) for b, t, f in zip(bags, toxic, fold) if f != k]
        yes, no = sum(t for _, t in rows), sum(1 - t for _, t in rows)
        for key in ("stupid$", "stupi", "fool$", "idiots$", "kind$"):
            has = lambda b: any(w + "$" == key or (w[: len(key)] == key and len(key) < len(w)) for w in b)
            inside, outside = sum(t for b, t in rows if has(b)), sum(1 - t for b, t in rows if has(b))
            odds = math.log((inside + 0.5) / (yes + 1)) - math.log((outside + 0.5) / (no + 1))
            assert lexicon.weights.get(key) == (pytest.approx(odds) if inside >= toxicity.RARE and odds > 2 else None)


def test_a_tree_s_first_cut_against_all_cuts():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)).round(1)
    y = ((x[:, 1] > 0.3) ^ (rng.random(200) < 0.1)).astype(float)
    trees = toxicity.Trees(x, y, trees=1)
    p = y.mean()
    slope, curve = y - p, np.full(200, p * (1 - p))
    best = (0.0, None)
    for j in range(3):
        for cut in trees.cuts[j]:
            left = x[:, j] <= cut
            g, h, a, b = slope.sum(), curve.sum(), slope[left].sum(), curve[left].sum()
            if b >= 1 and h - b >= 1 and (gain := a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)) > best[0] + 1e-12:
                best = (gain, (j, cut))
    assert trees.trees[0][0][:2] == (best[1][0], pytest.approx(best[1][1]))


def test_isotonic_against_its_formula():
    rng = np.random.default_rng(8)
    x, y = np.arange(30.0), (np.arange(30) / 30 + rng.normal(size=30) > 0.5).astype(float)
    xs, ys = toxicity.isotonic(x, y)
    for i in range(30):
        want = max(min(y[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1))
        assert np.interp(i, xs, ys) == pytest.approx(want)


# media


def test_media_query_against_plain_digests(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, "é" * 700), (51, "x" * 576), (52, "long " * 20_000)], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in docs.collect())
    got = sorted(queries.queries()["op5_media"](spark, str(tmp_path)).collect(), key=lambda r: (str(r["doc_id"]), r["n_bytes"]))
    for row, (doc_id, raw) in zip(got, sorted(texts, key=lambda x: (x[0], len(x[1]))), strict=True):
        payload = raw
        while not payload or len(payload) % 576:
            payload += b"\xff"
        assert (str(row["doc_id"]), row["n_bytes"], row["payload_bytes"]) == (doc_id, len(raw), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-32:])
        stream, points = media.mux(payload)
        assert (row["media_bytes"], row["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        told = dict(x.split("=") for x in row["feature"].split(";"))
        assert int(told["frames"]) == len(payload) // 576 and int(told["units"]) == int(told["points"]) == -(-len(payload) // media.UNIT) == len(points)
        assert int(told["mean"]) == sum(payload) * 1000 // len(payload) and int(told["power"]) == sum(b * b for b in payload) // len(payload) and int(told["peak"]) == max(payload)
        assert int(told["crossings"]) == sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))


def test_wrong_access_points_are_found(spark, odd):
    stored = media.store_media(odd.where("doc_id = 4")).selectExpr("doc_id", "n_bytes", "media", "transform(access, a -> named_struct('pts', a.pts + 1, 'offset', a.offset)) AS access")
    with pytest.raises(Exception, match="access points"):
        media.read_media(stored).collect()
