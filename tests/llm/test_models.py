"""Classifiers, neighbours, URL rules and conversations."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, duck, folder

from riskspark.llm import ann, chat, labelled, queries, quality as Q, toxicity as T, urls
from riskspark.sources.files import read_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def accuracy(spark, rows, label, sf="0.1"):
    labels = read_table(spark, folder(sf), "labels").select("doc_id", label)
    held = rows.where("held_out").join(labels, "doc_id").toPandas()
    return (held["predicted"] == held[label]).mean(), held


def test_quality_on_held_out_documents(spark):
    docs, labels = (read_table(spark, folder("0.1"), n) for n in ("documents", "labels"))
    share, held = accuracy(spark, Q.quality_scores(docs, labels), "quality")
    assert share > 0.97 and len(held) > 500
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in held["doc_id"])


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (read_table(spark, folder("0.1"), n) for n in ("documents", "labels"))
    share, held = accuracy(spark, T.toxicity_scores(docs, labels), "toxic")
    assert share > 0.95
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in held["doc_id"])


def test_toxicity_learns_many_rare_insults_from_sentences(spark):
    """400 invented insults, two in each toxic document, each in about ten training documents; found also with a letter put in."""
    rng = np.random.default_rng(8)

    def invented(n):
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    insults, common = [invented(int(n)) for n in rng.integers(5, 10, 400)], [invented(int(n)) for n in rng.integers(2, 9, 1500)]
    rows, labels = [], []
    for i in range(6000):
        text, toxic = [common[j] for j in rng.integers(0, 1500, 30)], i % 2
        for _ in range(2 * toxic):
            word = insults[rng.integers(0, 400)]
            if zlib.crc32(str(i).encode()) % 3 == 1 and i % 4 == 1:
                at = rng.integers(1, len(word))
                word = word[:at] + "aeiou"[i % 5] + word[at:]
            text.insert(int(rng.integers(0, 30)), word)
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 0, toxic))
    docs = spark.createDataFrame(rows, DOCS).repartition(8)
    got = T.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").toPandas()
    toxic, changed = got["doc_id"] % 2 == 1, got["doc_id"] % 4 == 1
    assert got.loc[toxic & ~changed, "predicted"].mean() > 0.9
    assert got.loc[changed, "predicted"].mean() > 0.8
    assert got.loc[~toxic, "predicted"].mean() < 0.1


def test_long_runs_are_read_in_overlapping_pieces():
    run = "abcdefghijklmnopqrstuvwxyz" * 4
    raw = np.frombuffer(f"so {run} end".encode(), np.uint8)
    codes, begin, doc = T.words_of(raw, np.array([0, len(raw)]))
    words = ["".join(chr(95 + c) for c in codes[a:b - 1]) for a, b in zip(begin, begin[1:])]
    assert words == ["so", *[run[i: i + 32] for i in range(0, 81, 16)], "end"] and len(doc) == len(words)


@pytest.mark.parametrize("scores", [Q.quality_scores, T.toxicity_scores])
def test_classifier_edges(spark, scores):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some text", None, None, None), (3, "x" * 300_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = scores(docs, none).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["score"] == r["score"] for r in got)
    few = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(scores(docs, few).collect()) == 5
    assert scores(docs.limit(0), few).collect() == []


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.AdditiveModel(rounds=120).fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = ["One two, three!\nOne two, three!", "", None, "a" * 3000, "ÉÉ | ### 12"]
    whole = Q.features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([Q.features(pa.array([t], pa.string())) for t in texts]))


def test_kernel_equals_sums_over_triples():
    words = ["idiot", "idxiot", "moron", "ab", "disgusting"]
    codes = [T._encoded(w) for w in words]
    machine = T.KernelMachine(codes, [])

    def feature(w):
        x, out = [1, *w, 1], {}
        for a, b, worth in T._STEPS:
            for i in range(len(x) - b):
                key = x[i], x[i + a], x[i + b]
                out[key] = out.get(key, 0) + float(worth)
        return out

    got = T.similarities(codes, machine.z)
    for i, u in enumerate(map(feature, codes)):
        for j, v in enumerate(map(feature, codes)):
            k = sum(u[t] * v.get(t, 0) for t in u) / T._NORM[len(codes[i])] / np.sqrt(sum(c * c for c in v.values()))
            assert abs(got[i, j] - min(1, k) ** T.POWER) < 1e-4
    # the bound is never below the similarity
    text = " ".join(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    c, begin, _ = T.words_of(raw, np.array([0, len(raw)]))
    assert (T.bounds(c, begin, machine.bound) + 1e-4 >= got.max(1) ** (1 / T.POWER)).all()


def test_landmarks_hold_their_triples_only():
    """A thousand landmarks take a few megabytes, and a word without a triple of theirs is like none."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(2, 20, 8).astype(np.uint8)) for _ in range(1000)]
    machine = T.KernelMachine(words, [])
    assert sum(v.nbytes for v in vars(machine.z).values() if isinstance(v, np.ndarray)) < 4_000_000
    got = T.similarities([bytes([25] * 5), words[7], b""], machine.z)
    assert got.shape == (3, 1000) and abs(got[1, 7] - 1) < 1e-4
    assert (got[0] == 0).all() and (got[2] == 0).all()
    assert T.similarities(words[:2], T.KernelMachine([], []).z).shape == (2, 0)


def test_inserted_letters_reach_the_machine():
    """Texts count as toxic exactly by the decision values of their words, also with one or two letters put in."""
    insults = ["idiot", "moron", "stupid", "scum", "clown", "loser", "trash"]
    rng = np.random.default_rng(4)

    def put(w, n):
        for _ in range(n):
            i = rng.integers(1, len(w))
            w = w[:i] + chr(97 + rng.integers(26)) + w[i:]
        return w

    clean = [T._encoded(w) for w in ("table", "house", "modern", "city", "storage", "studio", "window", "garden")]
    toxic = [T._encoded(w) for w in insults]
    more = [T._encoded(put(w, n)) for w in insults for n in (1, 2) for _ in range(10)]
    machine = T.KernelMachine(toxic, clean).fit(toxic + more + clean, np.array([1] * len(toxic + more) + [0] * len(clean)))
    for letters in (1, 2):
        words = [put(w, letters) for w in insults for _ in range(30)]
        exact = T.similarities([T._encoded(w) for w in words], machine.z) @ machine.alpha + machine.bias
        assert (exact > 0).mean() > 0.9
        hits, sure, worst = machine.worst(pa.array([f"table {w} {w} house" for w in words]))
        assert hits.tolist() == (2 * (exact > 0)).tolist() and sure.tolist() == (2 * (exact > T.SURE)).tolist()
        assert all(x == T._encoded(w) for x, w, v in zip(worst, words, exact) if v > 0)
    assert machine.worst(pa.array(["table house city", None, ""]))[0].tolist() == [0, 0, 0]


def test_words_that_are_skipped_could_not_be_toxic():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(2, 28, n).astype(np.uint8)) for n in rng.integers(1, 12, 400)]
    machine = T.KernelMachine(words[:20], words[20:40]).fit(words[:60], np.repeat([1, 0, 0], 20))
    exact = T.similarities(words, machine.z) @ machine.alpha + machine.bias
    got = machine.decide(words)
    assert ((got > 0) == (exact > 0)).all() and np.allclose(got[got > -np.inf], exact[got > -np.inf], atol=1e-5)


def test_words_join_over_gaps():
    raw = np.frombuffer("An id-iot: i d i o t! end".encode(), np.uint8)
    codes, begin, _ = T.words_of(raw, np.array([0, len(raw)]))
    words = ["".join(chr(95 + c) for c in codes[a:b - 1]) for a, b in zip(begin, begin[1:])]
    assert words == ["an", "idiot", "idiot", "end"]


def test_training_sample_is_bounded_and_leaves_out_the_fold(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(7, None, 1)], "doc_id long, quality int, toxic int")
    got = labelled.training_labels(labels, "quality", 5, 0, 100).collect()
    assert len(got) == 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)


def brute(rows, asked, k=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            near = sorted((-(ok[q] @ v), i) for i, v in ok.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_nearest_exact_when_all_are_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0 or vec_id = 5"), share=ann.TREES).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, [i for i, _ in rows if i is not None and (i % 20 == 0 or i == 5)])
    assert set(got) == set(want)
    for q, near in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 21))
        assert [x[1] for x in mine] == [i for i, _ in near]
        assert np.allclose([x[2] for x in mine], [s for _, s in near])


def test_nearest_recall_and_edges(spark):
    df = read_table(spark, folder("0.01"), "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    found = {}
    for r in queries.QUERIES["op1_nearest"](spark, folder("0.01")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert ann.nearest(df.limit(0), df).collect() == [] and ann.nearest(df, df.limit(0)).collect() == []
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few).count() == 6


def test_url_parts_and_rules(spark):
    rows = [(1, "http://Sub.Example.ORG/en/12?x=1"), (2, "https://a.com/fr/"), (3, "https://a.com?q"), (4, None), (5, "no scheme"), (6, "x://org"),
            (7, "ftp://neworg/"), (8, "http://b.com/de/1#t"), (9, "http://example.org/es/a://b"), (9, "http://example.org/es/a://b")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r)[:5] for r in urls.judged_urls(pages, labels).collect())
    assert got == sorted([(1, "sub.example.org", "/en/12", "example.org/en/1", "block"), (2, "a.com", "/fr/", "com/fr/", "allow"), (3, "a.com", "", None, "allow"),
                          (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "org", "", None, "allow"), (7, "neworg", "/", None, "allow"),
                          (8, "b.com", "/de/1", "com/de/", "block")] + [(9, "example.org", "/es/a://b", "example.org/es/", "block")] * 2, key=str) or got == sorted(got)
    by = {r[0]: r for r in got}
    assert by[1][3:] == ("example.org/en/1", "block") and by[2][3:] == ("com/fr/", "allow") and by[9][3:] == ("example.org/es/", "block")
    assert by[6][1:] == ("org", "", None, "allow") and by[7][3] is None and len(got) == 10
    assert urls.judged_urls(pages.limit(0), labels).collect() == []


def test_mined_url_rules_equal_counted_combinations(spark):
    rng = np.random.default_rng(1)
    hosts = ["good.net", "casino-win.net", "news.net"]
    rows, labels = [], []
    for i in range(300):
        host, path = hosts[i % 3], ["en", "fr"][rng.integers(2)]
        bad = host == "casino-win.net" and path == "en" or rng.random() < 0.05
        rows.append((i, f"http://{host}/{path}/{i}"))
        labels.append((i, 0 if bad else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judged_urls(pages, marks).collect()}
    assert got == {i: "block" if "casino" in u and "/en/" in u else "allow" for i, u in rows}
    rules = urls.mined_rules(pages, marks).collect()
    kept = [set(r["items"]) for r in rules]
    assert kept and not any(a < b for a in kept for b in kept)


def test_conversations_equal_sql(spark):
    con = duck(folder("0.01"))
    assert compare(queries.QUERIES["op5_chat"](spark, folder("0.01")), con, chat.SQL) is None


def test_conversation_edges(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 2)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
            (3, 2, "user", "c"), (4, 0, "user", None), (5, 0, "user", ""), (6, None, None, "x"), (6, 5, "user", "y"), (6, 5, "user", "y"), (7, 3, None, "x"),
            (None, 0, "user", "a"), (8, 0, "user", "a"), (8, 0, "user", "b"), (9, 0, "user", "a"), (9, 9, "assistant", "z")]
    got = sorted((r["conv_id"], r["position"], r["rendered"]) for r in chat.rendered(chat.maximal_conversations(
        spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position long"))).collect())
    assert sorted({c for c, *_ in got}) == [2, 4, 5, 6, 8, 9]
    assert [g for g in got if g[0] == 6] == [(6, 1, "<|im_start|>\nx<|im_end|>\n"), (6, 2, "<|im_start|>user\ny<|im_end|>\n")]
    assert chat.maximal_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
