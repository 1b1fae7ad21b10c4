"""License scans, quality rules, language identification and decontamination."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from corpora import SCHEMA, WORDS, corpus, frame, prose
from lodestone.llm import decontaminate as D, language_id as L, license_scan as C, quality_rules as Q


def test_license_scan_finds_all_contained_templates(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 80)) + " " + t.upper() + " " + prose(rng, rng.randint(0, 80)), "en", "s", 0) for i, t in enumerate(C.TEMPLATES.values())]
    for i, t in enumerate(C.TEMPLATES.values()):  # one word in twenty changed
        words = t.split()
        for k in range(10, len(words), 20):
            words[k] = "changed"
        rows.append((100 + i, prose(rng, 50) + " " + " ".join(words), "en", "s", 0))
    rows += corpus()
    templates = {}
    for name, t in C.TEMPLATES.items():
        w = C.template_words(t)
        templates[name] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {}
    for r in rows:
        w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (r[1] or "").lower()) if x]
        held = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for name, t in templates.items():
            share = len(t & held) / len(t)
            if share >= 0.8:
                want[r[0], name] = max(share, want.get((r[0], name), 0))
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in C.license_scan(frame(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert C.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_parts_count_wherever_they_stand(spark):
    rng = random.Random(2)
    parts = C.TEMPLATES["MIT"].split()
    halves = " ".join(parts[:30]) + " " + prose(rng, 600) + " " + " ".join(parts[26:])  # the seam's shingles are in the second part
    rows = [(1, halves, "en", "s", 0), (None, C.TEMPLATES["ISC"], "en", "s", 0), (None, C.TEMPLATES["ISC"] + " x", "en", "s", 0), (2, prose(rng, 60_000) + " " + C.TEMPLATES["BSD"] + " " + prose(rng, 60_000), "en", "s", 0)]
    got = sorted(((r["doc_id"], r["license_id"], r["containment"]) for r in C.license_scan(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", 1.0), (None, "ISC", 1.0), (None, "ISC", 1.0), (2, "BSD", 1.0)], key=str)


def test_license_bands_collide_with_the_stated_probability(spark):
    """Windows that share 4 of 8 shingles: 1 - (2/3) ** BANDS; bands agree no more often than independent ones."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(20_000):
        x = rng.integers(-(2**63), 2**63, 12).tolist()
        rows.append((x[:8], x[4:]))
    both = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").selectExpr(f"{C.minima('a')} as a", f"{C.minima('b')} as b")
    met = both.selectExpr("size(filter(zip_with(a, b, (x, y) -> x = y), e -> e)) as n").groupBy("n").count().collect()
    counts = {r["n"]: r["count"] for r in met}
    assert 1 - counts.get(0, 0) / 20_000 >= 0.997
    mean = sum(n * c for n, c in counts.items()) / 20_000
    variance = sum((n - mean) ** 2 * c for n, c in counts.items()) / 20_000
    assert abs(mean - C.BANDS / 3) < 0.05 and abs(variance - C.BANDS * 2 / 9) < 0.15


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_brute(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 2 * len(inside) > len(w))


def test_base_counts(spark):
    rows = corpus() + [(9000, "a b c a b c\nx\n\n x \nx\n | # $", "en", None, 1)]
    got = Counter((r["row"]["doc_id"], *(r[c] for c in Q.COUNTS)) for r in Q.judge(frame(spark, rows)).collect())
    assert got == Counter((r[0], *base_brute(r[1])) for r in rows)
    assert Q.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def mcd_brute(x):
    """The estimate of quality_rules in numpy: two starts, concentration steps on logarithmic distance bins."""

    def shape(rows, scale):
        m = rows.mean(axis=0)
        return m, ((rows.T @ rows) / len(rows) - np.outer(m, m)) * scale + Q.RIDGE * np.eye(Q.FEATURES)

    def median(v):
        bins = np.sort(np.floor(v * 256))
        counts = np.arange(1, len(v) + 1)
        return (bins[np.argmax(2 * np.array([counts[np.searchsorted(bins, b, "right") - 1] for b in bins]) >= len(v))] + 0.5) / 256

    mid = np.array([median(c) for c in x.T])
    mad = np.array([median(np.abs(c - m)) for c, m in zip(x.T, mid, strict=True)])
    best = None
    for m, s in ((mid, np.diag((mad * 1.4826) ** 2 + Q.RIDGE)), shape(x, 1.0)):
        for step in range(Q.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            bins = np.floor(np.log(d + 1e-9) * 64)
            order = np.sort(bins)
            cut = order[int(np.ceil(len(x) * Q.SHARE)) - 1]
            m, s = shape(x[bins <= cut], Q.consistency() if step == Q.STEPS - 1 else 1.0)
        if best is None or np.linalg.slogdet(s)[1] < best[0] - 1e-12:
            best = np.linalg.slogdet(s)[1], m, s
    _, m, s = best
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)


def vector(text):
    n, chars, symbols, dup, rep, _ = base_brute(text)
    lines = len([v for v in text.split("\n") if WORD.search(v)])
    return [np.log(n), 2 * np.log(chars / n), 4 * np.sqrt(symbols / chars), rep / n + dup / max(lines, 1)]


def distances_brute(rows):
    """Distance of each passing (.., text, lang, source, ..) row: by its group, its language or all, the first with LEAST_GROUP rows; None without."""
    passing = [r for r in rows if not base_brute(r[1])[-1]]
    scopes = [lambda r: (r[2], r[3]), lambda r: r[2], lambda r: None]
    out = {}
    for scope in scopes:
        groups = {}
        for r in passing:
            groups.setdefault(scope(r), []).append(r)
        for members in groups.values():
            if len(members) >= Q.LEAST_GROUP:
                found = mcd_brute(np.array([vector(r[1]) for r in members]))
                for r, d in zip(members, found, strict=True):
                    out.setdefault(r, d)
    return {r: out.get(r) for r in passing}


def test_outliers_are_those_of_the_numpy_estimate(spark):
    rng = random.Random(6)
    junk = lambda: " ".join(w + "###" for w in prose(rng, 100).split())
    rows = [(i, prose(rng, rng.randint(60, 400)), "en", "s1", 0) for i in range(150)]
    rows += [(200 + i, junk(), "en", "s1", 0) for i in range(8)]
    rows += [(300 + i, prose(rng, rng.randint(60, 300)), "en", f"small{i % 3}", 0) for i in range(30)] + [(350, junk(), "en", "small0", 0)]  # judged by the language
    rows += [(400 + i, prose(rng, 120), "fr", None, 0) for i in range(20)] + [(450, junk(), "fr", None, 0)]  # judged by all
    found = {r["row"]["doc_id"]: r for r in Q.judge(frame(spark, rows)).collect()}
    want = distances_brute(rows)
    assert all(d is not None for d in want.values())
    assert np.allclose([found[r[0]]["distance"] for r in want], list(want.values()), rtol=1e-6)
    junk_ids = {*range(200, 208), 350, 450}
    assert all(r["kept"] == (i not in junk_ids) for i, r in found.items())
    few = [r for r in rows if r[0] >= 400]  # too few in all
    assert all(r["kept"] and r["distance"] is None for r in Q.judge(frame(spark, few)).collect())


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) > 0
    rows = corpus()
    found = L.language_id(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    letterless = {r[0] for r in rows if not regex.search(r"\p{L}", r[1] or "")}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in letterless) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert L.language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    no_labels = spark.createDataFrame([(1, "text", None, None, 1)], SCHEMA)
    assert L.language_id(no_labels).first()["lang_pred"] == "und"


def test_language_scores_are_those_of_a_plain_version(spark):
    rows = corpus()
    docs = frame(spark, rows)
    model = L.fit(docs.select("doc_id", "text", "lang"), per_language=30)

    def buckets(text):
        folded = "".join(chr(b).lower() if chr(b).isalpha() and b < 128 else chr(b) if b > 127 else " " for b in (text or "").encode())
        padded, out = " " + folded + " ", []
        for size in (3, 4):
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if " " not in gram[1 : size - 1]:
                    h = 0
                    for c in gram:
                        h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                    out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
        return out

    want = {}
    for doc_id, text, *_ in rows:
        if regex.search(r"\p{L}", text or ""):
            b = buckets(text)
            raw = (model.logits[:, b].sum(axis=1, dtype=np.float64) / max(1, len(b)) + model.bias) / model.temperature
            p = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
            want[doc_id, text] = model.languages[int(p.argmax())], float(p.max())
        else:
            want[doc_id, text] = "und", 0.0
    got = L.predict(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) >= len(rows) - 1
    for r in got:
        name, score = want[r["doc_id"], r["text"]]
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-6


def test_every_language_is_learned_and_the_sample_is_bounded(spark):
    rng = random.Random(8)
    rows, words = [], {}
    for k in range(300):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 4)
        words[f"l{k:03}"] = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(6)]
    for k, (name, own) in enumerate(words.items()):
        rows += [(1000 * k + i, " ".join(rng.choice(own) for _ in range(40)), name, "s", 0) for i in range(10)]
    rows += [(10**6 + i, "the of and " * 20, "l000", "s", 0) for i in range(500)] + [(10**7, "the of and " * 20, "l001", "s", 0)] * 300
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    drawn = Counter(r["lang"] for r in L.training_rows(docs, 1000, 300 * 9).collect())
    assert len(drawn) == 300 and max(drawn.values()) <= 9
    got = L.language_id(docs.where("doc_id < 1000000"), sample=300 * 9).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.9 * len(got) and len({r["lang_pred"] for r in got}) > 256


def test_grams_stay_in_their_text():
    texts = [b"", b"Ab", b"ab cde", "é".encode(), b"123"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    both, counts = L.gram_buckets(data, offsets)
    ends = np.cumsum(counts)
    for i, t in enumerate(texts):
        alone, n = L.gram_buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert n[0] == counts[i] and sorted(alone) == sorted(both[ends[i] - counts[i] : ends[i]])


def planted(seed, items=25, docs=120):
    rng = random.Random(seed)
    vocabulary = [a + b + c for a in WORDS[:40] for b in ("", "er", "tion", "ly") for c in ("", "s", "en")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    bench = [(i, text(rng.randint(8, 40)) + " " + text(rng.randint(6, 15))) for i in range(items)]
    bench[0] = (0, text(150))
    rows, truth = [], set()
    for d in range(docs):
        t = text(rng.randint(0, 300))
        if d % 3 == 0:
            i = rng.randrange(items)
            w = bench[i][1].split()
            if d % 2:  # paraphrase: one word in eight replaced
                w = [rng.choice(vocabulary) if rng.random() < 0.125 else x for x in w]
            t += "\n" + " ".join(w).upper() + " " + text(rng.randint(0, 200))
            truth.add((d, i))
        rows.append((d, t, "en", "s", 0))
    return bench, rows, truth


def test_decontamination_recall_and_precision(spark):
    bench, rows, truth = planted(4)
    benchmark = spark.createDataFrame([*bench, (900, None), (901, ""), (902, "of")], "item_id bigint, text string").selectExpr("*", "1 as words")
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(frame(spark, rows + corpus()), benchmark).collect()}
    brute = set()
    items = D.read_items([{"item_id": i, "text": t} for i, t in [*bench, (902, "of")]])
    for r in rows + corpus():
        raw = (r[1] or "").encode()
        words = D.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        for item in items:
            m = len(item.words)
            for a in range(0, max(1, len(words) - m + 1), 4):
                part = words[max(0, a - 8) : a + m + 8]
                share = D.common_subsequence(item.words.tolist(), part) / m
                if share >= 0.9 or share >= 0.7 and D.common_subsequence(item.answer.tolist(), part) >= 0.5 * len(item.answer):
                    brute.add((r[0], item.item_id))
                    break
    assert len(got & truth) >= 0.9 * len(truth) and len(got & brute) >= 0.9 * len(brute)
    assert got <= brute | truth
    none = spark.createDataFrame([], SCHEMA)
    assert D.decontaminate(none, benchmark).count() == 0
    assert D.decontaminate(frame(spark, rows), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_decontamination_finds_long_items(spark):
    rng = random.Random(12)
    vocabulary = [a + b + c for a in WORDS[:40] for b in ("", "er", "tion", "ly") for c in ("", "s", "en")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench, rows, truth = [], [], set()
    for i, n in enumerate((280, 321, 400, 1000)):
        item = text(n)
        bench.append((i, " ".join(item) + "."))
        for k in range(4):  # two verbatim, two with one word in eight replaced
            words = [rng.choice(vocabulary) if k % 2 and rng.random() < 0.125 else x for x in item]
            rows.append((10 * i + k, " ".join(text(rng.randint(0, 150)) + words + text(rng.randint(0, 150))), "en", "s", 0))
            truth.add((10 * i + k, i))
    rows += [(100 + k, " ".join(text(700)), "en", "s", 0) for k in range(20)]
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == truth


def test_decontamination_finds_short_items_whatever_their_cosine(spark):
    rng = random.Random(21)
    vocabulary = [a + b + c for a in WORDS for b in ("", "er", "tion", "ly") for c in ("", "s", "en", "ing")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench, rows, truth = [], [], set()
    for n in (4, 5, 6, 7, 8, 12, 17, 40):
        for _ in range(12):
            i, item = len(bench), text(n)
            bench.append((i, " ".join(item)))
            if n >= 8 and i % 2:  # one word in eight replaced
                for k in range(3, n, 8):
                    item[k] = rng.choice(vocabulary)
            rows.append((i, " ".join(text(rng.randint(0, 150)) + item + text(rng.randint(0, 150))), "en", "s", 0))
            truth.add((i, i))
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(frame(spark, rows), benchmark).collect()}
    assert truth <= got and len(got) <= 1.05 * len(truth)
    none = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(frame(spark, rows), benchmark, cosine=2.0).collect()}
    assert truth <= none


def test_decontamination_finds_items_of_every_length(spark):
    """Verbatim and paraphrased items of 1 to 2,000 words: recall of each class, and nothing else is found."""
    rng = random.Random(33)
    vocabulary = [a + b + c + d for a in WORDS for b in ("", "er", "tion", "ly") for c in ("", "s", "en", "ing") for d in ("", "o")]
    rare = [f"q{i}x" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench, rows, truth = [], [], {}
    for n in (1, 2, 3, 4, 9, 30, 63, 64, 65, 129, 300, 321, 330, 800, 2000):
        for k in range(4):
            i, item = len(bench), [rare.pop() for _ in range(n)] if n < 4 else text(n)
            bench.append((i, " ".join(item) + "."))
            if n >= 9 and k % 2:  # one word in eight replaced
                item = [rng.choice(vocabulary) if at % 8 == 5 else w for at, w in enumerate(item)]
            rows.append((i, " ".join(text(rng.randint(0, 200)) + item + text(rng.randint(0, 200))), "en", "s", 0))
            truth.setdefault((n, n >= 9 and k % 2), set()).add((i, i))
            if 1 < n < 4:  # the words, but not one after another
                rows.append((1000 + i, " ".join(text(20) + item[:1] + text(1) + item[1:] + text(20)), "en", "s", 0))
    got = {(r["doc_id"], r["item_id"]) for r in D.decontaminate(frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert all(len(got & found) >= 0.9 * len(found) for found in truth.values()), {k: len(got & v) for k, v in truth.items()}
    assert got <= set().union(*truth.values())


def test_decontamination_passes_blocks_and_slices_change_nothing(spark, monkeypatch):
    bench, rows, _ = planted(9, items=23, docs=40)
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    docs = frame(spark, [*rows, (500, " ".join(r[1] for r in rows), "en", "s", 0)])
    whole = sorted(map(tuple, D.decontaminate(docs, benchmark).collect()))
    for name, value in (("BLOCK", 4), ("PASS", 9), ("SCORES", 60), ("FAN", 2)):
        monkeypatch.setattr(D, name, value)
    monkeypatch.setattr(D, "_tasks", lambda docs: 50)
    parts = sorted(map(tuple, D.decontaminate(docs, benchmark).collect()))
    assert [r[:4] for r in whole] == [r[:4] for r in parts] and len(whole) > 20
    assert np.allclose([r[4] for r in whole], [r[4] for r in parts], atol=1e-4)


def test_decontamination_orders_words_only_of_passages_that_may_reach_the_share(monkeypatch):
    """A repeated word counts as often as the item has it: passages full of one common word are not aligned."""
    rng = random.Random(8)
    item = [f"q{i}x" for i in range(19)] + ["the"]
    texts = [" ".join(["the"] * 300), " ".join(rng.choice(["the", "q3x"]) for _ in range(300)), " ".join([*WORDS[:30], *item, *WORDS[:30]])]
    aligned, whole = [], D.common_subsequence
    monkeypatch.setattr(D, "common_subsequence", lambda a, b: aligned.append(b) or whole(a, b))
    latent = D.Latent(np.random.default_rng(1).standard_normal((D.TERMS, D.RANK)).astype(np.float32), np.ones(D.TERMS))
    items = D.read_items([{"item_id": 5, "text": " ".join(item)}])
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for out in D._search(latent, [items], 0.35, 0.7, 0.9, 0.5)(iter([batch])) for r in out.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["lcs_share"]) for r in rows] == [(3, 5, 1.0)]
    assert aligned and all(len(set(b)) >= 14 for b in aligned)


def test_passages_add_up_whatever_their_length_and_the_frequency_of_their_terms(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(D, "DENSE", 3)
    size = np.concatenate([rng.integers(1, 65, 300), np.full(50, 64)])
    bounds = np.concatenate([[0], np.cumsum(size)])
    terms = np.where(rng.random(bounds[-1]) < 0.5, rng.integers(0, 20, bounds[-1]), rng.integers(0, D.TERMS, bounds[-1])).astype(np.uint16)
    a = np.array([np.bincount(terms[i:j], minlength=D.TERMS) for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
    assert (a.sum(axis=0) > D.RARE).any() and (a > 1).any()
    y, df, w = np.zeros((D.TERMS, D.TEST)), np.zeros(D.TERMS), D.test_matrix()
    D._add_passages(y, df, w, terms, bounds)
    assert (df == (a > 0).sum(axis=0)).all() and np.allclose(y, a.T @ (a @ w.astype(np.float64)), rtol=1e-4, atol=1e-2)


def test_latent_space_is_that_of_all_passages(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [a + b + c for a in WORDS[:40] for b in ("", "er", "tion", "ly") for c in ("", "s", "en")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in [0, 1, 63, 64, 65, 70_000, *[rng.randint(0, 300) for _ in range(60)]]]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    whole = D.fit(docs)
    monkeypatch.setattr(D, "SAMPLE", 20, raising=False)  # what a corpus 50 times as large was cut to
    again = D.fit(docs)
    assert np.allclose(np.abs(whole.rows @ whole.rows.T), np.abs(again.rows @ again.rows.T), rtol=1e-2, atol=1e-2 * np.abs(whole.rows @ whole.rows.T).max())
    a = []
    for t in texts:
        terms = D._terms(D.words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
        a += [np.bincount(terms[k : k + 64], minlength=D.TERMS) for k in range(0, len(terms), 64)]
    a = np.array(a, np.float64)
    assert np.array_equal(whole.df, (a > 0).sum(axis=0))
    parts = docs.select("text").mapInArrow(D._sums, "slice int, y binary, df binary, passages bigint").collect()
    y = np.zeros((D.SLICES, D.TERMS // D.SLICES, D.TEST))
    for r in parts:
        y[r["slice"]] += np.frombuffer(r["y"], np.float32).reshape(y.shape[1:])
    want = a.T @ (a @ D.test_matrix())
    assert np.allclose(y.reshape(want.shape), want, rtol=1e-3, atol=1e-4 * np.abs(want).max()) and sum(r["passages"] for r in parts) == len(a)


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.common_subsequence(a, b) == table[-1][-1]
