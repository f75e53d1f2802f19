from __future__ import annotations

import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rillmark.llm import jsd_quality, langid, qgram_leaks, zstd_toxicity
from rillmark.llm.url_templates import Rule, judge_urls

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def test_language_model_keeps_twenty_thousand_words(spark):
    rng = random.Random(1)
    many = sorted({"".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(21_000)})
    df = spark.createDataFrame([(i, " ".join(many[i::50]), "xx") for i in range(50)], "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert len(model.words) == 20_000 and len(model.grams[5]) == 10_000


# quality rules


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_counts(wide, docs, rows):
    got = jsd_quality.judge(wide, jsd_quality.references(docs)).collect()
    mine = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = Counter()
    for r in rows:
        n, chars, symbols, dup, repeat = base_counts(r[1])
        want[r[0], n, chars, symbols, dup, repeat, n < 10 or 100 * repeat > 20 * n] += 1
    assert mine == want
    assert not any(r.kept for r in got if r.base_failed)


def test_repeats_and_lines_by_hand(spark):
    texts = ["a b c d e f\na b c d e f\n \n \nx", "a a a a a a", "#$ é|<", "line\nline\r\nline", "one\n" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in jsd_quality.judge(df, jsd_quality.References([], np.empty((0, 8)), [], [])).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}


def test_references_count_the_whole_corpus(spark, docs, rows):
    refs = jsd_quality.references(docs)
    assert refs.langs == ["de", "en"]
    for lang, common, shares in zip(refs.langs, refs.common, refs.shares, strict=True):
        counts = Counter(w for r in rows if r[2] == lang for w in WORD.findall(r[1] or ""))
        total = sum(counts.values())
        want = sorted(n / total for n in counts.values() if n / total >= jsd_quality.COMMON_SHARE)
        assert sorted(shares[:-1]) == pytest.approx(want) and len(common) == len(want)
        assert shares.sum() == pytest.approx(1)
    none = jsd_quality.references(docs.where("lang is null"))
    assert none.langs == [] and all(r.kept != r.base_failed for r in jsd_quality.judge(docs, none).collect())


def test_distance():
    p = np.array([[0.5, 0.5, 0], [0, 0, 1.0], [0.2, 0.3, 0.5]])
    q = np.array([0.5, 0.5, 0])
    got = jsd_quality.js_distance(p, q)
    assert got[0] == 0 and got[1] == pytest.approx(1)
    m = (p[2] + q) / 2
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    assert got[2] == pytest.approx(np.sqrt((kl(p[2], m) + kl(q, m)) / 2))


def test_odd_documents_are_rejected_and_clean_ones_kept(spark):
    rng = random.Random(1)
    common = ["the", "of", "and", "to", "in"]
    clean = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n))
    odd = ["".join(rng.choices("#$%*", k=3)) + "".join(rng.choices(string.digits, k=4)) for _ in range(300)]
    rows = [(i, clean(rng.randrange(50, 400)), "en") for i in range(200)] + [(900, " ".join(odd), "en"), (901, " ".join(odd[:30]), "en"), (902, clean(25), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in jsd_quality.judge(df, jsd_quality.references(df)).collect()}
    assert all(got[i].kept for i in range(200)) and not got[900].kept
    # under the guard nothing is compared
    assert got[901].kept and got[901].nearest is None and got[902].kept


# language


def corpus(spark, n=300, seed=2):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "der"], "cc": ["ñez", "ción", "os", "la"]}
    text = lambda lang, k: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(k))
    rows = [(i, text(lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(rng.choices(list(parts), k=n))]
    return spark.createDataFrame([*rows, (9000, None, "aa"), (9001, "12 34 !!", "bb"), (9002, "", None), (9003, rows[0][1], None)], "doc_id long, text string, lang string"), rows


def test_held_out_accuracy(spark):
    docs, rows = corpus(spark)
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify_languages(docs, model).select("*", langid.held_out().alias("held")).collect()
    held = [r for r in found if r.held and r.doc_id < 9000]
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert got[9000] == got[9001] == got[9002] == ("und", 0.0) and got[9003][0] == rows[0][2]
    assert all(0 <= s <= 1 for _, s in got.values())


def test_predictions_equal_naive_counts_and_scores(spark):
    """Model and scores again with dictionaries: word, else the mean of the longest known n-grams."""
    docs, rows = corpus(spark, 120, 5)
    rng = random.Random(6)
    fresh = [(5000 + i, " ".join("".join(rng.choices(["ka", "lo", "sch", "ung", "ción", "zz", "Q"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    counts = {}
    for text, lang in [(t, lang) for _, t, lang in rows] + [("12 34 !!", "bb"), ("", "aa")]:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for n in range(1, 6):
                counts.setdefault((lang, n), Counter()).update(f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n))
    langs = sorted({lang for lang, _ in counts})
    log = lambda lang, n, u: np.log((counts[lang, n][u] + 0.5) / (sum(counts[lang, n].values()) + len(counts[lang, n]) + 1))
    known = lambda n, u: any(counts[lang, n][u] for lang in langs)

    def score(lang, w):
        if known(0, w):
            return log(lang, 0, w)
        for n in range(5, 0, -1):
            hits = [g for i in range(len(w) + 3 - n) if known(n, g := f"_{w}_"[i : i + n])]
            if hits:
                return np.mean([log(lang, n, g) for g in hits])
        return 0.0

    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(spark.createDataFrame(fresh, "doc_id long, text string"), langid.learn(docs)).collect()}
    for i, text in fresh:
        found = re.findall(r"[^\W\d_]+", text.lower())
        total = np.array([sum(score(lang, w) for w in found) for lang in langs])
        want = 1 / np.exp((total - total.max()) * min(len(found), 20) / len(found)).sum()
        assert got[i][0] == langs[int(total.argmax())] and got[i][1] == pytest.approx(want, rel=1e-3)


def test_backoff_uses_the_longest_known_order():
    grams = {3: ["abc"], 2: ["xy"], 1: ["q"]}
    logs = {3: np.array([[-1, -9]], np.float32), 2: np.array([[-9, -1]], np.float32), 1: np.array([[-2, -3]], np.float32)}
    model = langid.Model(["a", "b"], ["known"], np.array([[-5, -1]], np.float32), grams, logs)
    scores = langid.Scores(model)
    assert scores.backoff("zabcxyz").tolist() == [-1, -9]
    assert scores.backoff("zxyz").tolist() == [-9, -1] and scores.backoff("zqz").tolist() == [-2, -3] and scores.backoff("zz").tolist() == [0, 0]
    assert scores.identify("known")[0] == "b" and scores.identify("ABCabc")[0] == "a"
    assert scores.identify("zz") == ("a", 0.5)


def test_remembered_words_are_bounded():
    model = langid.Model(["a"], ["w"], np.array([[-1]], np.float32), {}, {})
    scores = langid.Scores(model)
    scores.room = 10
    for i in range(100):
        scores.identify(" ".join("".join(random.Random(i * 50 + j).choices(string.ascii_lowercase, k=9)) for j in range(30)))
        scores.forget()
        assert len(scores) <= 1 + 10 + 30


def test_all_columns_stay_and_no_labels_means_unknown(wide, empty, rows):
    model = langid.learn(empty)
    found = langid.identify_languages(wide, model)
    assert set(wide.columns) <= set(found.columns)
    assert {(r.lang_pred, r.score) for r in found.collect()} == {("und", 0.0)} and found.count() == len(rows)
    assert langid.identify_languages(empty, model).count() == 0


# toxicity


def toxic_corpus(spark, n=700, seed=4):
    rng = random.Random(seed)
    bad = ["worthless", "moron", "vequ"]
    plain = lambda k: ["".join(rng.choices(["th", "er", "on", "an", "in", "ed"], k=rng.randrange(1, 4))) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        toxic, w = int(rng.random() < 0.2), plain(rng.randrange(20, 120))
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            word = rng.choice(bad)
            w[rng.randrange(len(w))] = word + rng.choice(plain(5)) if word == "vequ" else word
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs += [(9000, None), (9001, ""), (None, "moron moron moron")]
    labels += [(None, 1, 1), (5, 1, None), (8888, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found(spark):
    docs, labels = toxic_corpus(spark)
    model = zstd_toxicity.learn(docs.where(~langid.held_out()), labels)
    got = {r.doc_id: (r.score, r.held) for r in zstd_toxicity.score_toxicity(docs, model).select("*", langid.held_out().alias("held")).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id is not None and r.doc_id < 9000 and r.doc_id != 8888}
    held = [(got[i][0], t) for i, t in truth.items() if got[i][1]]
    assert len(held) > 80
    assert sum(s >= 0.5 for s, t in held if t) >= 0.95 * sum(t for _, t in held)
    assert sum(s >= 0.5 for s, t in held if not t) <= 0.03 * sum(1 - t for _, t in held)
    assert got[9000][0] == got[9001][0] == 0.0 and all(0 <= s <= 1 for s, _ in got.values())


def test_scores_are_compressed_lengths_of_the_text(spark):
    """The score of every text again, with zstandard alone, a word at a time."""
    import zstandard

    docs, labels = toxic_corpus(spark)
    model = zstd_toxicity.learn(docs.where(~langid.held_out()), labels)
    assert len(model.pairs) == zstd_toxicity.PAIRS and all(a != b for a, b in model.pairs)
    length = lambda raw, text: len(
        zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(raw)).compress(text)
    )
    half = len(model.evidence) // 2
    got = {r.text: r.score for r in zstd_toxicity.score_toxicity(docs.where("doc_id % 70 = 0"), model).collect()}
    assert len(got) > 5
    for words, score in got.items():
        total = 0.0
        for w in re.findall(r"\w+", words.lower()):
            text = f" {w} ".encode() + zstd_toxicity.CARRIER
            d = sum(length(o, text) - length(t, text) for o, t in model.pairs)
            total += model.evidence[max(-half, min(half, d)) + half]
        far = total - model.threshold
        assert score == pytest.approx(0.5 + 0.5 * far / (1 + abs(far)))


def test_the_fit_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = toxic_corpus(spark)
    seen = []
    monkeypatch.setattr(zstd_toxicity, "FIT_BYTES", 40_000)
    monkeypatch.setattr(zstd_toxicity, "_fit", lambda fit, rest, seed: seen.append([*fit[0], *fit[1], *rest[0], *rest[1]]))
    zstd_toxicity.learn(docs, labels)
    assert 20_000 < sum(len(t.encode()) for t in seen[0]) <= 40_000


def test_chance_does_not_add_up_in_long_texts():
    weights = zstd_toxicity._weights(Counter({0: 9_000, 5: 200, 30: 20}), Counter({0: 880, 5: 22, 30: 20}))
    reach = len(weights) // 2
    assert weights[reach] == weights[reach + 5] < 0 < weights[reach + 30]
    # what ordinary text has by chance comes to nothing, however long it is
    assert zstd_toxicity._evidence(Counter({0: 900_000, 5: 20_000, 30: 2_000}), weights) == pytest.approx(0, abs=0.05 * 2_000 * zstd_toxicity.MOST_EVIDENCE)


def test_without_both_classes_scores_are_zero(wide, empty, spark):
    labels = spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int")
    assert zstd_toxicity.learn(wide, labels) is None and zstd_toxicity.learn(empty, labels) is None
    assert {r.score for r in zstd_toxicity.score_toxicity(wide, None).collect()} == {0.0}


def test_threshold():
    assert zstd_toxicity._threshold(np.array([0.0, 0, 1]), np.array([3.0, 5])) == 2.0
    assert zstd_toxicity._threshold(np.array([0.0]), np.array([0.0])) == 1.0


# benchmark passages


def edit_distance_to_piece(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(8)
    for _ in range(300):
        pattern = bytes(rng.choices(b"ab", k=rng.randrange(5, 30)))
        k = rng.randrange(0, 4)
        own = bytearray(pattern)
        for _ in range(rng.randrange(0, k + 2)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = bytes(rng.choices(b"abc", k=rng.randrange(2)))
        before = bytes(rng.choices(b"ab", k=rng.randrange(0, k + 1)))
        text = before + bytes(own) + bytes(rng.choices(b"ab", k=4))
        want = edit_distance_to_piece(pattern, text)
        got = qgram_leaks.banded_distance(pattern, text, k)
        if got:
            assert got[0] >= want
        near = edit_distance_to_piece(pattern, bytes(own))
        if near <= k:
            assert got and got[0] <= near


def leak_tables(spark):
    rng = random.Random(6)
    item = lambda n: " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(n))
    items = {1: item(40), 2: item(12), 3: item(25), 4: "tiny", 5: ""}
    filler = lambda: item(60)

    def edited(text, n):
        chars = list(text)
        for at in rng.sample(range(len(chars)), n):
            chars[at] = rng.choice(["", "#", chars[at] + "#"])
        return "".join(chars)

    docs = {
        10: filler() + " " + items[1] + " " + filler(), 11: items[2], 12: filler() + "\n" + items[3].upper().replace(" ", "  \n") + " " + filler(),
        13: filler() + " " + edited(items[1], 6) + " " + filler(), 14: filler() + items[1][20:140], 15: items[2][: len(items[2]) // 3] + filler(),
        16: filler(), 17: "tiny", 18: "", 19: None, 20: items[1] + "\n" + items[2],
    }
    rows = [*docs.items(), (10, docs[10]), (None, items[1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items.items(), (None, items[1]), (6, None)], "item_id long, text string")


def test_leaks(spark):
    docs, items = leak_tables(spark)
    got = {(r.doc_id, r.item_id): r for r in qgram_leaks.leaked_passages(docs, items).collect()}
    assert set(got) == {(10, 1), (11, 2), (12, 3), (13, 1), (14, 1), (20, 1), (20, 2)}
    assert got[10, 1].edits == 0 and got[13, 1].windows >= 2
    text = docs.where("doc_id = 10").first().text.encode()
    item = items.where("item_id = 1").first().text.encode()
    assert text[got[10, 1].begin : got[10, 1].end] == item
    kept = {r.doc_id for r in qgram_leaks.drop_contaminated(docs, items).collect()}
    assert kept == {15, 16, 17, 18, 19, None}


@pytest.mark.parametrize("chars", [qgram_leaks.INDEX_CHARS, 50])
def test_rows_without_id_are_dropped_by_their_own_text(spark, monkeypatch, chars):
    docs, items = leak_tables(spark)
    monkeypatch.setattr(qgram_leaks, "INDEX_CHARS", chars)
    more = docs.union(spark.createDataFrame([(None, "harmless"), (None, None)], "doc_id long, text string"))
    kept = qgram_leaks.drop_contaminated(more, items, null_ids=True).collect()
    assert {r.doc_id for r in kept} == {15, 16, 17, 18, 19, None}
    assert Counter(r.text for r in kept if r.doc_id is None) == Counter(["harmless", None])


def test_leaks_index_by_index_and_without_rows(spark, monkeypatch):
    docs, items = leak_tables(spark)
    want = Counter(qgram_leaks.leaked_passages(docs, items).collect())
    monkeypatch.setattr(qgram_leaks, "INDEX_CHARS", 50)
    assert Counter(qgram_leaks.leaked_passages(docs, items).collect()) == want
    assert qgram_leaks.leaked_passages(docs, items.where("false")).count() == 0
    assert qgram_leaks.leaked_passages(docs.where("false"), items).count() == 0


def edited_piece(pattern, text):
    """Least edits between ``pattern`` and any piece of ``text``."""
    row = np.zeros(len(text) + 1, int)
    letters = np.frombuffer(text, np.uint8)
    for i, c in enumerate(pattern, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (letters != c))
        new = np.r_[i, best]
        # insertions run to the right
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def folded(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", (text or "").translate({c: c + 32 for c in range(65, 91)})).encode()


@pytest.mark.parametrize("piece", [qgram_leaks.SLICE, 40])
def test_leaks_equal_a_full_alignment_of_all_windows(spark, monkeypatch, piece):
    """A pair leaks if some window of the item has a piece of the document within its edits: every pair, full distances."""
    monkeypatch.setattr(qgram_leaks, "SLICE", piece)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(3, 60))) for i in range(12)] + [(50, "ab " * 60)]
    docs = []
    for i in range(60):
        base = rng.choice(items)[1]
        at = rng.randrange(len(base))
        part = list((base + " " + base)[at : at + rng.randrange(60, 300)])
        for _ in range(rng.randrange(0, 6)):
            j = rng.randrange(len(part) or 1)
            part[j : j + rng.randrange(2)] = rng.choices("xyzé ", k=rng.randrange(2))
        docs.append((i, prose(rng.randrange(0, 30)) + rng.choice([" ", "\n\t ", ""]) + "".join(part).replace("a", "A") + " " + prose(rng.randrange(0, 30))))
    docs += [(70, "ab " * 400), (71, "ba ab " * 50)]
    want = set()
    for item, t in items:
        flat = folded(t).strip()
        windows = {flat[max(0, min(b, len(flat) - 80)) :][:80] for b in range(0, max(1, len(flat) - 60), 20)} if len(flat) > 80 else {flat}
        for d, text in docs:
            if any(len(w) >= 10 and edited_piece(w, folded(text)) <= len(w) * 5 // 100 for w in windows):
                want.add((d, item))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in qgram_leaks.leaked_passages(df.selectExpr("*", "1 item_id", "2 begin", "3 _leaking_id"), bench).collect()}
    assert got == want and 20 < len(want) < 200
    clean = df.selectExpr("*", "1 item_id", "2 begin", "3 _leaking_id")
    kept = qgram_leaks.drop_contaminated(clean, bench)
    assert kept.columns == clean.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_the_bound_is_positive_for_all_windows():
    assert all(qgram_leaks._least(n) > 0 for n in range(qgram_leaks.Q, qgram_leaks.WINDOW + 1))
    assert pa is not None


# urls

RULES = (Rule("allow", "org", "/"), Rule("block", "a.org", "/x/"), Rule("block", "a.org", "/x"), Rule("block", "net", "/spam/"))


def test_hosts_paths_and_rules(spark):
    urls = [
        "https://WWW.A.org/x/1?q#f", "http://a.org", "http://a.org/xy", "http://ba.org/x/", "ftp://h.net#/x", "no scheme", None, "", "://", "x://é.Net/Ü/p?://z", "http://u@h.com:80/p//q",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES).collect()}
    assert got == {
        0: ("www.a.org", "/x/1", "a.org/x/", "block"), 1: ("a.org", "", None, "allow"), 2: ("a.org", "/xy", "a.org/x", "block"), 3: ("ba.org", "/x/", "org/", "allow"),
        4: ("h.net", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("é.net", "/Ü/p", None, "allow"), 10: ("u@h.com:80", "/p//q", None, "allow"),
    }


def test_templates_are_rejected_by_their_labels(spark):
    pages = [(i, f"http://h.com/good/{i}.html") for i in range(40)] + [(100 + i, f"http://h.com/bad/{i}/page{i}") for i in range(40)]
    pages += [(200 + i, f"http://h.com/{'abcdefghijklmnop'[i % 16] * (i // 16 + 1)}/list") for i in range(60)]
    labels = [(i, 0) for i in range(10)] + [(100 + i, 1) for i in range(10)] + [(200 + i, 0) for i in range(10)] + [(None, 1), (5000, 1), (3, None)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge_urls(df, (), spark.createDataFrame(labels, "page_id long, blocked int")).collect()}
    assert {i for i, v in got.items() if v == "block"} == set(range(100, 140))
    # too few labels to go against the prior
    few = {r.verdict for r in judge_urls(df, (), spark.createDataFrame(labels[10:11], "page_id long, blocked int")).collect()}
    assert few == {"allow"}


def test_unlabelled_branches_have_their_ancestors_purity(spark):
    """Planted hosts: a section without any label is blocked where its host or its parent mostly is, and nowhere else."""
    pages, labels = [], []

    def section(host, path, n, bad=None):
        for i in range(n):
            labels.extend([] if bad is None else [(len(pages), int(i < bad))])
            pages.append((len(pages), f"http://{host}/{path}/{i}"))

    section("spam.net", "win", 30, 30), section("spam.net", "buy", 3, 3), section("spam.net", "new", 5)
    section("mixed.net", "bad", 40, 40), section("mixed.net", "good", 60, 0), section("mixed.net", "other", 5)
    section("mixed.net", "bad/deep/er", 4), section("clean.net", "a", 30, 1), section("clean.net", "b", 5), section("none.net", "x", 5)
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = judge_urls(df, (), spark.createDataFrame(labels, "page_id long, blocked int")).collect()
    assert {(r.host, r.path.rsplit("/", 1)[0]) for r in got if r.verdict == "block"} == {
        ("spam.net", "/win"), ("spam.net", "/buy"), ("spam.net", "/new"), ("mixed.net", "/bad"), ("mixed.net", "/bad/deep/er"),
    }


def test_a_hot_host_with_many_labels(spark):
    """Products of counts of this size overflow a long."""
    df = spark.range(130_000).selectExpr("id page_id", "concat('http://h.net/', if(id % 2 = 0, 'spam', 'ham'), '/', id) url")
    got = judge_urls(df, (Rule("block", "net", "/spam/"), Rule("allow", "net", "/ham/"))).groupBy("verdict").count().collect()
    assert {(r.verdict, r["count"]) for r in got} == {("block", 65_000), ("allow", 65_000)}


def test_url_edge_cases(spark):
    df = spark.createDataFrame([(None, "http://a.org/x/"), (1, "http://h.com/" + "a/" * 300), (1, "http://h.com/" + "a/" * 300)], "page_id long, url string")
    rows = judge_urls(df.selectExpr("*", "1 as rule", "2 as host", "3 as verdict", "4 as shape", "5 as template"), RULES).collect()
    assert len(rows) == 3 and {r.verdict for r in rows} == {"allow", "block"} and max(r.shape.count("/") for r in rows) == 299
    assert judge_urls(df.where("false"), RULES).count() == 0


def test_every_labelled_language_can_be_predicted(spark, monkeypatch):
    # 230 languages, each with words of its own; the last is the rarest
    own = lambda i, k: "".join(chr(97 + (i // 26**j + k * (j + 1)) % 26) for j in range(3)) * 2
    rows = [(i * 10 + d, f"l{i:03}", " ".join(own(i, k) for k in range(6))) for i in range(230) for d in range(1 if i == 229 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs, langid.learn(docs)).collect()}
    assert found[2290] == "l229" and sum(found[d] == lang for d, lang, _ in rows) >= 0.95 * len(rows)
    assert langid.units_kept(30) == (20_000, 10_000) and langid.units_kept(230)[0] < 400 and langid.units_kept(10_000) == (1, 1)
