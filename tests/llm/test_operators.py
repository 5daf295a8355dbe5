import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowsync.llm import components, fingerprints, language_id, line_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 4000
#: Null, empty, repeated, tied, spaced and very long texts; ids that are null or repeated; columns with names used inside.
TEXTS = [
    (1, "The cat sat on the mat and then it sat again.\nShared line\n\n  SHARED line \t", "en", "src0"), (2, None, None, None), (3, "", "en", "src0"), (4, " \n\t ", "fr", None), (5, LONG, "en", "src0"),
    (6, "mail me at bob.x@mail.example.com or +1 (243) 555-5526, ip 10.0.255.7 card 4111 1111 1111 1111 end", "en", "src1"), (6, "mail me at bob.x@mail.example.com or +1 (243) 555-5526, ip 10.0.255.7 card 4111 1111 1111 1111 end", "en", "src1"),
    (None, "no id here é ñ 日本語 ☃", "es", "src1"), (8, "one", "en", "src2"), (9, "a" * 30000, "en", "src2"),
]
ROWS = [(*t, len(t[1] or ""), "x", "y") for t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(spark, docs, none):
    out = fingerprints.fingerprints(docs.where("doc_id is not null")).collect()
    assert len(out) == len(ROWS) - 1 and fingerprints.fingerprints(none).count() == 0
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    by_id = {r["doc_id"]: r for r in out}
    for k, r in enumerate(rows):
        t, following = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        if r[0] != 6:
            assert by_id[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 6}) == 1


@pytest.mark.parametrize("buckets", [1, 3, 40, 5000])
def test_next_row_for_any_number_of_buckets(spark, buckets):
    ids = random.Random(3).sample(range(-1000, 100_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    ordered = sorted(ids)
    wanted = dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))
    got = fingerprints.with_next(df, "i", {"x": df["i"].alias("x")}, buckets).collect()
    assert len(got) == len(ids) and all(wanted[r["id"]] == r["next_x"] for r in got)


def brute_fingerprint(spark, tokens_of):
    """Sketches by the definition, over the same token hashes."""
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in sorted({t for ts in tokens_of for t in ts})], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    pairs = sorted({(hashes[a], hashes[b]) for ts in tokens_of for a, b in zip(ts, ts[1:], strict=False)})
    pair = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(pairs, "a long, b long").selectExpr("a", "b", "xxhash64(a, b) AS h").collect()}
    chosen = []
    for ts in tokens_of:
        s = [pair[hashes[a], hashes[b]] for a, b in zip(ts, ts[1:], strict=False)]
        chosen.append([(i, s[i], s[i + 2], s[i + 3]) for i in range(len(s) - 3) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])])
    triples = sorted({x[1:] for c in chosen for x in c})
    low = {(r["a"], r["b"], r["c"]): r["h"] for r in spark.createDataFrame(triples, "a long, b long, c long").selectExpr("a", "b", "c", "shiftrightunsigned(xxhash64(a, b, c), 32) AS h").collect()}
    return [[(i, low[x, y, z]) for i, x, y, z in c] for c in chosen]


def test_fingerprints_by_definition(spark):
    rng = random.Random(18)
    tokens_of = [[rng.choice("abcdefghijklmnopqrstuvw") * 2 for _ in range(rng.choice([9, 40, 400]))] for _ in range(30)]
    tokens_of[3] = tokens_of[2][:30] + tokens_of[1]
    want = brute_fingerprint(spark, tokens_of)
    df = spark.createDataFrame([(k, " ".join(ts)) for k, ts in enumerate(tokens_of)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    places = {r["doc_id"]: [tuple(x) for x in r["a"]] for r in df.select("doc_id", fingerprints.anchors(df.text).alias("a")).collect()}
    sketches = [sorted({h for _, h in w})[: fingerprints.SKETCH] for w in want]
    for k, w in enumerate(want):
        assert places[k] == w
        if w:
            assert got[k]["fingerprint"] == "".join(f"{h:08x}" for h in sketches[k])
            b = sketches[(k + 1) % len(want)]
            if b:
                union = sorted({*sketches[k], *b})[: fingerprints.SKETCH]
                assert abs(got[k]["near_next"] - sum(x in sketches[k] and x in b for x in union) / len(union)) < 1e-12


def test_syncmers_ignore_context(spark):
    rng = random.Random(1)
    words = [str(rng.randrange(10**6)) for _ in range(60)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join([*words[:30], "changed", *words[30:]]),)], "t string")
    a, b = (set(r[0]) for r in df.select(fingerprints.syncmers(df.t)).collect())
    assert 10 < len(a) < 45 and len(a - b) <= 4


def test_short_texts_have_their_own_fingerprints(spark):
    rng = random.Random(12)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.choice([1, 4, 5, 6, 7]))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    assert len({got[k]["fingerprint"] for k in range(200)}) == len(set(texts)) and all(r["fingerprint"] for r in got.values())
    assert all(got[k]["fingerprint"] == got[k + 200]["fingerprint"] and got[k]["near_next"] == 0 for k in range(200))


def brute_lines(texts, least):
    keys = [[re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for t in texts]
    count = Counter(k for ks in keys for k in set(ks) if k)
    return [("\n".join(x for x, k in zip((t or "").split("\n"), ks, strict=True) if count[k] < least or not k), sum(1 for k in ks if k and count[k] >= least)) for t, ks in zip(texts, keys, strict=True)]


def test_line_dedup(spark, docs, none):
    rng = random.Random(2)
    texts = [t for _, t, *_ in TEXTS] + ["\n".join(rng.choice(["A b", " a B\t", "c", "É", "é", "", "d" + str(rng.randrange(40))]) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in line_dedup.line_dedup(df, min_docs=10).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts, 10)
    assert line_dedup.line_dedup(none).count() == 0 and line_dedup.line_dedup(docs, min_docs=2).count() == len(ROWS)


def test_line_dedup_in_batches(spark):
    """Several batches and levels, lines settled early and late, very frequent ones, rows repeated across batches."""
    rng = random.Random(20)
    texts = ["\n".join([*(f"L{min(rng.randrange(60), rng.randrange(60))}" for _ in range(5)), "everywhere"]) for _ in range(300)] + ["same row\nL1"] * 12 + ["x" * 50_000 + "\n" + "y" * 50_000, "\n".join(f"n{k}" for k in range(5000))]
    df = spark.createDataFrame([(k if t != "same row\nL1" else 7000, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for n in (1, 6):
        got = sorted((r["row"]["doc_id"], r["kept_text"], r["n_dropped"]) for r in line_dedup.line_dedup(df.repartition(3), min_docs=10, n_batches=n).collect())
        want = sorted((k if t != "same row\nL1" else 7000, *w) for (k, t), w in zip(enumerate(texts), brute_lines(texts, 10), strict=True))
        assert got == want, n


def test_line_runs_compact_without_moving_runs(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2, buckets=4)
    for part in (["x\ny", "x"], ["x\nz"], ["z\nx", "z"]):
        runs.add(line_dedup.count_lines(spark.createDataFrame([(t,) for t in part], "text string")))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert runs.frequent().count() == 2
    merged = runs.merged()
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["n"] for r in merged.collect()) == [1, 3, 4]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rowsync_lines")]


def test_language_id(spark, docs, none):
    en, de = "the cat and the dog with the house of that man ", "der hund und die katze mit dem haus von diesem mann "
    rows = [(k, (en if k % 2 else de) * 3, "en" if k % 2 else "de", f"h{k % 3}.example.com") for k in range(60)] + [(100, en * 2, "de", None), (101, de, None, None), (102, "0f9a8b7c6d5e4f3a2b1c" * 9, None, None), (103, None, None, None), (104, None, "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    got = {r["id"]: r for r in language_id.identify(df, declared=df.lang, host=df.host, suffix=language_id.address_suffix(df.host)).collect()}
    assert all(got[k]["language"] == ("en" if k % 2 else "de") and got[k]["kept"] for k in range(60))
    assert [got[k]["language"] for k in (100, 101, 102, 103, 104)] == ["en", "de", "und", "und", "de"]
    assert language_id.identify_documents(docs).count() == len(ROWS) and language_id.identify_documents(none).count() == 0
    assert spark.range(1).select(language_id.declared_language(language_id.F.lit("<!doctype html><HTML class=x lang='De-AT'>"))).first()[0] == "de"


def test_text_in_no_known_language_is_rejected(spark):
    """Limits come from the byte counts alone: text that no declared language explains, random characters among them."""
    rng = random.Random(23)
    said = {"en": "the cat and the dog with the house of that man went over to see what they had been told about ", "de": "der hund und die katze mit dem haus von diesem mann sind nicht mehr hier gewesen als wir "}
    rows = [(k, " ".join(rng.sample(said[lang].split(), 12)), lang) for k, lang in enumerate(["en", "de"] * 300)]
    odd = ["Съешь ещё этих мягких французских булок да выпей чаю " * 3, "今天天气很好我们去公园散步" * 5, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)), "".join(rng.choice("0123456789abcdef") for _ in range(300))]
    df = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r["id"]: r["kept"] for r in language_id.identify(df, declared=df.lang).collect()}
    assert not any(got[1000 + k] for k in range(len(odd))) and sum(got[k] for k in range(600)) == 600


def test_rare_languages_have_their_own_class(spark, monkeypatch):
    said = {"en": "the cat and the dog with the house of that man ", "de": "der hund und die katze mit dem haus von diesem mann ", "it": "questo gatto vuole mangiare nella nostra bella cucina oggi ", "fi": "tämä kissa haluaa syödä meidän kauniissa keittiössämme tänään "}
    rows = [(k, said[lang] * 3, lang) for k, lang in enumerate(["en", "de"] * 200 + ["it", "fi"])] + [(500, said["it"], None), (501, said["fi"], "en"), (502, None, "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["id"]: r for r in language_id.identify(df, declared=df.lang).collect()}
    assert [got[k]["language"] for k in (0, 1, 400, 401, 500, 501, 502)] == ["en", "de", "it", "fi", "it", "fi", "it"] and all(r["kept"] for r in got.values())
    monkeypatch.setattr(language_id, "TABLES", 1)  # a pass for each language
    monkeypatch.setattr(language_id, "SENDABLE", 0)  # evidence by shuffle
    again = {r["id"]: r for r in language_id.identify(df, declared=df.lang).collect()}
    assert all(again[k]["language"] == r["language"] and abs(again[k]["posterior"] - r["posterior"]) < 1e-9 for k, r in got.items())


def test_language_id_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = language_id.identify_pages(pages).collect()
    said = {r["page_id"]: re.search('lang="(..)"', r["html"])[1] for r in pages.collect()}
    assert len(got) == len(said) and np.mean([said[r["id"]] == r["language"] for r in got]) > 0.9


def test_quality_classifier_held_out(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    got = quality_classifier.op4_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    held = got[got["held_out"]].assign(y=lambda x: x["doc_id"].map(labels)).dropna()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (held["y"] == held["predicted"]).mean() > 0.9
    rules = quality_classifier.learn({n: np.arange(100.0) for n in quality_classifier.statistics(quality_classifier.F.lit(""))}, (np.arange(100) > 50).astype(int))
    assert quality_classifier.score(docs, *rules).count() == len(ROWS) and quality_classifier.score(none, *rules).count() == 0
    assert quality_classifier.learn({}, np.zeros(0))[1] == []


def test_compiled_rules_score_like_the_rules(spark, docs):
    rng = np.random.default_rng(19)
    rows = [(k, " ".join(rng.choice(["Aa", "b!", "c", "|", "7"], int(rng.integers(0, 60)))), int(rng.integers(0, 2))) for k in range(400)]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "!" in t and y or 0) for k, t, y in rows] + [(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    intercept, rules = quality_classifier.train(df.unionByName(df.limit(50)), labels)
    stats = quality_classifier._with_statistics(df, [df.doc_id]).select("doc_id", "__stat.*").toPandas()
    x = {n: stats[n].to_numpy(float) for n in stats.columns if n != "doc_id"}
    want = dict(zip(stats["doc_id"], 1 / (1 + np.exp(-(intercept + sum(r.weight * r.holds(x) for r in rules)))), strict=True))
    got = {r["id"]: r["score"] for r in quality_classifier.score(df, intercept, rules).collect()}
    assert rules and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_sentencepiece_viterbi_is_best():
    rng = random.Random(4)
    pieces = ["▁", "a", "b", "c", "ab", "abc", "▁a", "▁ab", "bc", "ca", "▁▁", "cab"]
    scores = [-rng.random() * 5 for _ in pieces]
    m = sentencepiece.Unigram([*pieces, *[f"<0x{k:02X}>" for k in range(256)]], [*scores, *[0.0] * 256], ["piece"] * len(pieces) + ["byte"] * 256)
    worth = dict(zip(pieces, scores, strict=True))

    def best(w):
        top = [0.0] + [-1e9] * len(w)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                s = worth.get(w[i:j], m.unknown if j == i + 1 else None)
                if s is not None:
                    top[j] = max(top[j], top[i] + s)
        return top[-1]

    words = ["▁" + "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    ids, lengths = m.encode_words(words)
    for w, x in zip(words, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        unknown = sum(c not in worth for c in w)
        assert abs(sum(m.scores[i] for i in x if i < len(pieces)) + unknown * m.unknown - best(w)) < 1e-9
    texts = ["", "ab cab", " a  b ", "é☃\n", "a▁b"]
    assert [x.decode() for x in m.decode(*m.encode(pa.array(texts)))] == ["", "ab cab", " a  b ", "é☃\n", "a b"]


def test_sentencepiece_long_words_need_little_memory():
    import resource

    rng = random.Random(14)
    m = sentencepiece.loaded(packing.tokenizer_path("piece_bpe_32k.model"))
    letters = "etaoinshrdlu日本語のé0123456789ABCxyz+/"
    word = "".join(rng.choice(letters) for _ in range(3000))
    assert m._search_long("▁" + word).tolist() == m._search(["▁" + word])[0].tolist()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "".join(rng.choice(letters) for _ in range(120_000)) + " " + " ".join("".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 900]))) for _ in range(900))
    ids, offsets = m.encode(pa.array([text]))
    assert len(text) > 350_000 and m.decode(ids, offsets)[0].decode() == text
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes


def test_sentencepiece_query(spark, docs, none):
    got = sentencepiece.encode(docs, with_ids=True).collect()
    assert len(got) == len(ROWS) and all(r["round_trip"] for r in got) and sentencepiece.encode(none).count() == 0
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0

    def good(kind, v):
        n = re.sub(r"\D", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]

    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in BASE.items() for m in re.finditer(p, text) if good(kind, m[0])]


def test_pii(spark, docs, none):
    rng = random.Random(5)
    bits = ["a@b.co", "a.b@c-d.e.f_g@h.i", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (2) 3-4.567", "+49 30 12345678", "x", "é", "日", " ", " ", "@", ".", "-", "12", "+", "\n", "@@", "a@b", "9" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [t for _, t, *_ in TEXTS]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r for r in pii.personal_data(df).select("id", pii.as_string(pii.F.col("base")).alias("base"), pii.as_string(pii.F.col("spans")).alias("spans")).collect()}
    for k, t in enumerate(texts):
        want = brute_base(t or "")
        assert got[k]["base"] == ",".join(want), t
        assert set(want) <= set(filter(None, got[k]["spans"].split(",")))
    assert pii.personal_data(docs).count() == len(ROWS) and pii.personal_data(none).count() == 0


def test_pii_query_against_brute_force(spark, tmp_path):
    """The query's own columns: several spans of a kind, kinds in any number, repeated rows, null ids and texts."""
    mail, ip, card, phone = "a@b.co ", "1.2.3.4 ", "x 4111 1111 1111 1111 x ", "+49 30 12345678 x "
    rng = random.Random(61)
    texts = [None, "", "x", mail, ip, card, phone, mail * 5, ip * 5, card * 5, phone * 5, mail + ip * 2 + card * 3 + phone * 4, phone + card * 2 + ip * 3 + mail * 4]
    texts += ["".join(rng.choice([mail, ip, card, phone, "é ", "😀", "\n"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [*enumerate(texts), (11, texts[11]), (None, texts[12]), (-1, texts[12])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.op6_pii(spark, str(tmp_path)).collect())
    bases = [(i, brute_base(t or "")) for i, t in rows]
    want = Counter((i, *[sum(x.startswith(f"{kind}:") for x in b) for kind in BASE], hashlib.sha256(",".join(b).encode()).hexdigest()) for i, b in bases)
    assert got == want


def test_pii_of_long_log_text_takes_seconds(spark):
    import time

    lines = [f"2024-01-{k % 28 + 1:02d} 10.{k % 250}.{k % 200}.{k % 7} user{k}@mail.example.com +1 555 {k % 900 + 100} {k % 9000 + 1000} id={k * 7919 % 10**9} é" for k in range(12_000)]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.redact(df).collect()
    assert len(text) > 900_000 and row["clean_text"].count("[EMAIL]") == len(lines) and "@" not in row["clean_text"]
    assert time.time() - began < 240


def test_pii_spans_overlap_and_are_free(spark):
    rng = random.Random(15)
    F = pii.F
    kind = "array<struct<k:int,s:int,e:int>>"
    rows = []
    for k in range(60):
        span = lambda: (0, a := rng.randrange(0, 400), a + rng.randint(1, 30))
        rows.append((k, [span() for _ in range(rng.choice([0, 1, 3, 90]))], [span() for _ in range(rng.choice([0, 2, 70]))]))
    df = spark.createDataFrame(rows, f"id int, base {kind}, more {kind}")
    got = {r["id"]: [tuple(x) for x in r["free"]] for r in df.select("id", pii._free(F.col("more"), F.col("base")).alias("free")).collect()}
    for k, base, more in rows:
        assert got[k] == [c for c in more if not any(b[1] < c[2] and c[1] < b[2] for b in base)]
    sums = df.select("id", pii._running(F.transform("base", lambda x: x["s"])).alias("r"), pii._running(F.transform("base", lambda x: x["s"]), pii._greatest).alias("m")).collect()
    for r in sums:
        starts = [b[1] for b in rows[r["id"]][1]]
        assert r["r"] == np.cumsum(starts).tolist() and r["m"] == [max(starts[: i + 1]) for i in range(len(starts))]


def test_pii_learns_by_chains_of_patterns(spark):
    """Known numbers teach the word before them; what is found there teaches the next word, for more turns than three."""
    words, sizes, lines = ["alpha", "beta", "gamma", "delta"], [12288, 1536, 192, 24, 3], []
    tail = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
    rng = random.Random(24)
    for step, n in enumerate(sizes):
        for k in range(n):  # each number once after the word that is known by then, and once after the next one
            number = f"+49 30 555{k:05d}" if not step else f"0{step}0-5{k:06d}"
            lines += [f"{w} {number} {tail()}" for w in words[max(0, step - 1) : step + 1] if step or w == "alpha"]
    rows = [(k, "\n".join(lines[k::50])) for k in range(50)]
    spans = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).agg(pii.F.sum(pii.F.size("spans"))).first()[0]
    assert spans == len(lines)


def test_pii_learns_from_context(spark):
    rows = [(k, f"please call +49 30 555{k:05d} now") for k in range(20)] + [(100, "please call 030-5551234 now"), (101, "order 030-5559999 pieces")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["s"] for r in pii.personal_data(df).select("id", pii.as_string(pii.F.col("spans")).alias("s")).collect()}
    assert got[100] == "phone:12:23" and got[101] == ""
    clean = {r["row"]["doc_id"]: r["clean_text"] for r in pii.redact(df).collect()}
    assert clean[100] == "please call [PHONE] now" and clean[101] == rows[-1][1] and clean[0] == "please call [PHONE] now"


def test_pii_learns_numbers_in_groups_and_short_addresses(spark):
    rows = [(k, f"please call +49 30 555{k:05d} now") for k in range(20)] + [(20 + k, f"write to a{k}@mail.example.com today") for k in range(20)]
    rows += [(100, "please call 030 555 1234 now"), (101, "please call (030) 5551 2345 now"), (102, "order 030 555 9999 pieces"), (103, "write to bob@localhost today"), (104, "please call 12345678 now"), (105, "please call 1-2-3-4-5-6-7-8 now")]
    got = {r["id"]: r["s"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("id", pii.as_string(pii.F.col("spans")).alias("s")).collect()}
    assert [got[k] for k in range(100, 106)] == ["phone:12:24", "phone:12:27", "", "email:9:22", "phone:12:20", "phone:12:27"]


def test_packing(spark, docs, none):
    got = packing.pack(docs).toPandas()
    coder = packing.Coder(packing.tokenizer_path("byte_bpe_50k.json"))
    seen = set()
    for _, t, *_ in TEXTS:
        ids = coder.model.encode(t or "", add_special_tokens=False).ids + [1]
        assert coder.encode(pa.array([t], pa.string()))[0].tolist() == ids[:-1]
        seen.add(len(ids))
    assert set(got["doc_tokens"]) == seen and got["length"].sum() == sum(len(coder.model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in TEXTS)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = g["length"].cumsum()
        assert (g["offset"] == ends - g["length"]).all() and ends.iloc[-1] <= 2048 and (ends.iloc[-1] & (ends.iloc[-1] - 1)) == 0
    assert packing.pack(none).count() == 0


def test_hilbert_is_a_curve():
    side = 8
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(side * side))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_columns(spark):
    rng = random.Random(16)
    docs = {k: " ".join(rng.choice(["word", "other", "text", "ünï", "42"]) for _ in range(rng.choice([0, 3, 40, 3000]))) for k in range(60)}
    got = packing.pack(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")).toPandas()
    coder = packing.Coder(packing.tokenizer_path("byte_bpe_50k.json"))
    for k, text in docs.items():
        ids = np.array(coder.model.encode(text, add_special_tokens=False).ids + [1], "<u4")
        g = got[got["doc_id"] == k].sort_values("start")
        assert g["start"].tolist() == (np.cumsum(g["length"]) - g["length"]).tolist() and g["length"].sum() == len(ids) and (g["doc_tokens"] == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)] == g["ids_crc32"].tolist()


def test_reputation_estimates_its_strength(spark):
    rng = np.random.default_rng(17)
    F = url_filter.F
    for true in (4.0, 60.0):
        n = rng.integers(5, 60, 4000)
        bad = rng.binomial(n, rng.beta(0.3 * true, 0.7 * true, 4000))
        df = spark.createDataFrame(list(zip(n.tolist(), bad.tolist(), strict=True)), "n long, bad long")
        assert true / 1.4 < url_filter.strength(df, "n", "bad", F.lit(0.3)) < true * 1.4
    none = spark.createDataFrame([], "n long, bad long")
    assert url_filter.strength(none, "n", "bad", F.lit(0.3)) == url_filter.STRENGTH
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.com",), ("m.x.com",), ("localhost",), ("",)], "h string")
    got = {r[0]: (r[1], r[2]) for r in hosts.select("h", *url_filter.levels(F.col("h"))).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("x.com", "com"), "m.x.com": ("x.com", "com"), "localhost": ("localhost", "localhost"), "": ("", "")}


def test_url_filter(spark):
    from compare import assert_same

    assert_same(url_filter.op8_url_filter(spark, "/root/testdata/sf0.01"), url_filter.SQL, "/root/testdata/sf0.01")
    rows = [(1, None), (2, "nothing"), (3, "http://A.Example.ORG/es/x?y"), (4, "x://h.com#f"), (5, "ftp://org"), (6, "http://a.com/de/\n1"), (6, "http://a.com/de/\n1")]
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1][:3] == ("", "", None) == got[2][:3] and got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4][:3] == ("h.com", "", None) and got[5][:3] == ("org", "", None) and got[6][:3] == ("a.com", "/de/\n1", "com/de/")
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality_rules(spark, docs, none):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) + rng.choice(["", "\nx y\nx y\n \n", "\x1c#*\u2003<z"]) for _ in range(80)] + [t for _, t, *_ in TEXTS]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        kept = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(kept) - len(set(kept)), len(covered))
        assert want == tuple(got[k][f] for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), t[:80]
        assert got[k]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (got[k]["base_failed"] and got[k]["kept"])
    assert quality_rules.quality_rules(docs).count() == len(ROWS) and quality_rules.quality_rules(none).count() == 0


def test_bands_follow_the_good_rows_and_judge_short_texts(spark):
    rng = random.Random(13)
    known = ["".join(rng.choice("aeiou" if i % 2 else "bdlmnrst") for i in range(rng.randint(2, 7))) for _ in range(300)]
    clean = [" ".join(rng.choice(known) for _ in range(rng.randint(60, 160))) for _ in range(400)]
    short = [" ".join(rng.choice(known) for _ in range(14)) for _ in range(10)]
    bad = [" ".join("".join(rng.choice("qxzjkvwpyghc") for _ in range(5)) for _ in range(n)) for n in (12, 15, 20, 30)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*clean, *short, *bad])], "doc_id long, text string, lang string")
    good = spark.range(0, 300).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df, good=good).collect()}
    assert not any(got[k]["base_failed"] or got[k]["kept"] for k in range(410, 414)) and got[410]["n_grams"] < 200
    assert sum(got[k]["kept"] for k in range(400)) >= 390 and sum(got[k]["kept"] for k in range(400, 410)) >= 9


def brute_kneser_ney(words_of: dict) -> dict:
    """Probability of each n-gram (language, bytes), by the textbook's recursion over a dictionary of counts."""
    order, out = quality_rules.ORDER, {}
    for lang, words in words_of.items():
        counts = {order: Counter()}
        for w in words:
            marked = [255] * (order - 1) + list(re.sub("[0-9]", "0", w.lower()).encode()) + [255]
            counts[order].update(tuple(marked[i : i + order]) for i in range(len(marked) - order + 1))
        raw = dict(counts)
        for k in range(order - 1, 0, -1):
            raw[k], counts[k] = Counter(), Counter()
            for g, n in raw[k + 1].items():
                raw[k][g[1:]] += n
                counts[k][g[1:]] += 1
            if k > 1:
                counts[k].update({g: raw[k][g] - counts[k][g] for g in raw[k] if g[0] == 255})

        def probability(g, counts=counts):
            k = len(g)
            if not k:
                return 1 / 256
            n1, n2, n3, n4 = (max(1.0, sum(c == i for c in counts[k].values())) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [max(0.05, min(top, v)) for v, top in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.9))]
            cut = {h: min(d[min(c, 3) - 1], c * 0.95) for h, c in counts[k].items() if h[:-1] == g[:-1]}
            total = sum(counts[k][h] for h in cut)
            return (counts[k][g] - cut[g]) / total + sum(cut.values()) / total * probability(g[1:])

        out |= {(lang, *g): (n, probability(g)) for g, n in counts[order].items()}
    return out


def test_kneser_ney(spark):
    rng = random.Random(9)
    words_of = {k: ["".join(rng.choice("abAé7") for _ in range(rng.randint(1, 7))) for _ in range(150)] for k in (1, 2)}
    df = spark.createDataFrame([(k, " ".join(w[i::3])) for k, w in words_of.items() for i in range(3)], "lang long, text string").select("text", "lang")
    got = {r["key"]: (r["n"], r["cost"]) for r in quality_rules.kneser_ney(quality_rules._counted(df, sound=False)).collect()}
    want = {}
    for g, v in brute_kneser_ney(words_of | {0: words_of[1] + words_of[2]}).items():
        key = g[0]
        for b in g[1:]:
            key = key << 8 | b
        want[key] = v
    assert set(got) == set(want) and all(got[k][0] == n and abs(got[k][1] / quality_rules.UNIT + np.log(p)) < 1e-5 for k, (n, p) in want.items())


def test_perplexity_is_the_same_however_few_keys_are_sent(spark, docs, monkeypatch):
    rng = random.Random(10)
    rows = [(k, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for k in range(60)]
    df = spark.createDataFrame([*rows, rows[0], (None, "zq " * 90, "en")], "doc_id long, text string, lang string")
    all_sent = sorted(map(tuple, quality_rules.quality_rules(df).collect()), key=str)
    for heavy in (1, 64):
        monkeypatch.setattr(quality_rules, "HEAVY", heavy)
        assert sorted(map(tuple, quality_rules.quality_rules(df).collect()), key=str) == all_sent
    assert len(all_sent) == 62 and any(r[-1] != all_sent[0][-1] for r in all_sent)


def test_model_grows_with_the_corpus(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(12)), 0) for _ in range(4000)], "text string, lang long")
    n = [quality_rules._counted(df.limit(k), sound=False).count() for k in (500, 4000)]
    assert n[1] > 5 * n[0]


def test_one_of_each_finds_near_copies_and_keeps_the_rest(spark, none):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(120)]
    rows, copies = [(k, " ".join(b), "a", 1) for k, b in enumerate(base)], []
    for k, b in enumerate(base[:60]):
        near = list(b)
        near[rng.randrange(200)] = "edited"
        near.insert(rng.randrange(200), "more")  # ten of some 200 shingles differ, similarity 0.9
        copies.append((1000 + k, " ".join(near), "b", 2))
    rows += copies + [(5, rows[5][1], "a", 1), (None, rows[6][1], "n", 3), (None, "a text of its own that nobody else has and that is long enough", "n", 4), (2000, "", "e", 5), (2001, None, "e", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, row int")
    got = [tuple(r) for r in simhash.one_of_each(df).collect()]
    left = Counter(r[0] for r in got)
    assert df.columns == simhash.one_of_each(df).columns and all(left[k] == 1 for k in range(120))
    assert not any(left[1000 + k] for k in range(60)) and left[None] == 1 and left[2000] == 1 and not left[2001]
    assert simhash.one_of_each(none).count() == 0


def test_wide_links_are_those_of_all_pairs():
    rng = np.random.default_rng(22)
    centres = rng.integers(-(1 << 63), (1 << 63) - 1, (30, 4))  # four words
    rows = []
    for c in centres:
        for _ in range(20):
            x = c.copy()
            for bit in rng.integers(0, 256, int(rng.integers(0, 40))):
                x[bit // 64] ^= np.int64(1) << np.int64(bit % 64)
            rows.append(x)
    x = np.array(rows)
    x = x[np.unique(x[:, 0], return_index=True)[1]]
    d = np.bitwise_count((x[:, None] ^ x[None]).view(np.uint64))
    near = (d[:, :, 0] <= 14) & (d.sum(2) <= 45)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([root[near[k]].min() for k in range(len(x))])
    u, v = simhash.links(x, None, 14, 45)
    labels = {int(a): int(a) for a in x[:, 0]} | dict(zip(u.tolist(), v.tolist(), strict=True))
    same = np.array([labels[int(a)] for a in x[:, 0]])
    assert ((same[:, None] == same[None]) == (root[:, None] == root[None])).all() and 1 < len(set(root)) < len(x)


def test_simhash(spark, docs, none):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghijk") for _ in range(30)) for _ in range(25)]
    texts = base + [b + " zz" for b in base[:10]] + base[:5] + [t for _, t, *_ in TEXTS]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: (r["fp"], r["component_id"]) for r in simhash.near_groups(df, radius=6).collect()}
    fps = np.array([simhash.fingerprint(t or "") for t in texts], np.int64)
    assert [got[k][0] for k in range(len(texts))] == fps.tolist()
    group = list(range(len(texts)))
    for _ in range(len(texts)):
        group = [min(group[j] for j in np.nonzero(np.bitwise_count((fps ^ fps[k]).view(np.uint64)) <= 6)[0]) for k in range(len(texts))]
    assert [got[k][1] for k in range(len(texts))] == group
    assert simhash.near_groups(docs).count() == len(ROWS) and simhash.near_groups(none).count() == 0


def test_links_connect_as_all_pairs_do():
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 62, 40)
    a = np.unique(np.concatenate([c ^ (1 << rng.integers(0, 62, 40)) for c in centres]))
    u, v = simhash.links(a, None, 4)
    assert len(u) == len(a) - 40 and len(np.unique(v)) == 40
    u, v = simhash.links(a[::2].copy(), a[1::2].copy(), 4)
    assert len(np.union1d(u, v)) == len(a)


def test_checksum_of_many_rows_does_not_overflow(spark):
    many = spark.range(0, 20_000_000, 1, 8).selectExpr("id AS u", "id + 1 AS v")
    assert many.agg(components.checksum("u", "v")).first()[0] is not None


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 201), (201, 202), (200, 202)]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {101: 100, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
