import random
import re
import time
import zlib

import numpy as np

from codequarry.llm import subjects as S
from codequarry.llm.subjects import Sparse, _numbers, about, add_terms, features, fit_mixtures, normalized, subject_areas, weighted

TOPICS = {
    "sea": "harbour anchor sailor mast tide vessel rudder compass voyage island lagoon reef".split(),
    "farm": "tractor barley orchard meadow harvest poultry manure fodder ploughing silage vineyard livestock".split(),
    "music": "violin cello concerto melody soprano trombone chorus rhythm lyric orchestra tempo harmony".split(),
}
COMMON = [
    "we keep one row for each {0} and link it to the {1}.", "the screen for the {0} shows the {1} next to it.",
    "deleting a {0} must never delete its {1}.", "add a column for the {0}, next to the one for the {1}.",
]
REMARK = ["off topic, does anyone here know about {0}?", "someone joked that it feels like waiting for a {0}."]


def make(n, seed=5):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        chosen = rng.sample(sorted(TOPICS), rng.choice((0, 1, 1, 1, 2)))
        lines = []
        for s in chosen:
            for _ in range(6):
                lines.append(rng.choice(COMMON).format(*rng.sample(TOPICS[s], 2)))
        if rng.random() < 0.5:
            lines.append(rng.choice(REMARK).format(rng.choice(TOPICS[rng.choice(sorted(TOPICS))])))
        lines.append("thanks, this reads much better now.")
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), "en", "x"))
        truth[i] = set(chosen)
    return docs, truth


def test_features_split_identifiers_and_fold_accents():
    one = set(features("bar_line BarLine bar line")[0].tolist())
    assert len(one) == len(set(features("bar line bar")[0].tolist()))
    assert features("Prüfungsnote")[0].tolist() == features("pruefungsnote")[0].tolist()
    assert features(None)[0].tolist() == features("")[0].tolist() == []
    assert features("a b. c")[1].tolist() == features("")[1].tolist()


def test_updates_never_lessen_the_fit():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 200, 60).astype(np.int32) for _ in range(40)]
    v = Sparse.of(codes)
    w = normalized(np.where(np.arange(256)[:, None] < 200, rng.random((256, 4)), 0))
    last = -np.inf
    for _ in range(6):
        h = fit_mixtures(v, w, inner=30)
        model = np.einsum("ij,ij->i", h[v.rows], w[v.columns])
        likelihood = float((v.values * np.log(np.maximum(model, 1e-12))).sum() - h.sum())
        assert likelihood >= last - 1e-2 * abs(likelihood)
        last = likelihood
        into = np.zeros(w.shape)
        add_terms(v, h, w, into)
        w = normalized(into)


def test_held_out_accuracy(spark):
    docs, truth = make(500)
    rng = random.Random(1)
    labels = []
    for i in range(0, 500, 5):
        named = sorted(truth[i]) or ["none"]
        if rng.random() < 0.05:
            named = [rng.choice(sorted(TOPICS))]
        labels += [(i, s) for s in named] * rng.choice((1, 2))
    labels += [(99_999, "sea"), (None, "sea"), (1, None)]
    documents = spark.createDataFrame([*docs, (700, None, None, "x"), (701, "", "de", "x"), (None, "anchor", "en", "x")], "doc_id bigint, text string, lang string, subject string")
    found: dict = {}
    for r in subject_areas(spark, documents, spark.createDataFrame(labels, "doc_id bigint, subject string"), [(s, "") for s in sorted(TOPICS)]).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
        assert 0 < r.share <= 1
    assert not {700, 701, None} & set(found)
    held = [i for i in truth if i % 5]
    hits = sum(len(found.get(i, set()) & truth[i]) for i in held)
    precision = hits / sum(len(found.get(i, set())) for i in held)
    recall = hits / sum(len(truth[i]) for i in held)
    assert precision > 0.9 and recall > 0.9, (precision, recall)


def test_a_sentence_adds_to_every_subject_it_bears():
    texts = ["The anchor is next to the tractor.\nA tractor and an anchor.", "The violin.\nThe tractor stands.", "Nothing."]
    codes, units = zip(*[features(x) for x in texts], strict=True)
    known = np.unique(np.concatenate(codes))  # the dictionary of these texts
    codes = [_numbers(c, known)[0] for c in codes]
    stands = np.zeros((256, 3), np.float32)
    for k, word in enumerate(("anchor", "tractor", "violin")):
        stands[_numbers(features(word)[0], known)[0], k] = 0.9
    v = weighted(list(codes), list(units), stands, np.zeros(256, np.float32))
    found = about(fit_mixtures(v, normalized(stands * 1000), inner=None))
    assert found.tolist() == [[True, True, False], [False, True, True], [False, False, False]]


def test_the_dictionary_counts_documents_and_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(S, "_HELD", 40)  # counts are given away in between
    rows = [(i, "common words here", [f"w{i % 7}"] * 3, "rare" if i < 2 else "") for i in range(60)]
    texts = [(i, " ".join([a, *b, c])) for i, a, b, c in rows]
    table = S.featurize(spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id bigint, text string, lang string"), spark.createDataFrame([], "doc_id bigint, subject string"), ["x"], ["en"])
    want = {}
    for _, t in texts:
        for c in set(features(t)[0].tolist()):
            want[c] = want.get(c, 0) + 1
    assert S.dictionary(table, 60).tolist() == sorted(c for c, n in want.items() if n >= 3)
    assert S.dictionary(table, 2_000_000).tolist() == sorted(c for c, n in want.items() if n >= 20)


def test_many_subjects_and_other_languages(spark):
    """More subjects than a number has bits, and a language that no rule names."""
    words = [f"{a}{b}tor" for a in "bdfgklmn" for b in "aeiouyaeio"][:70]
    subjects = [(f"s{i}", f"matter of {w}") for i, w in enumerate(words)]
    docs = [(i, f"le {words[i % 70]} est grand.\nun {words[i % 70]} est la.", "fr") for i in range(700)]
    labels = [(i, f"s{i % 70}") for i in range(0, 350)]
    found = subject_areas(spark, spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), subjects)
    got = {r.doc_id: r.subject for r in found.collect()}
    distinct = [i for i in range(350, 700) if words.count(words[i % 70]) == 1]
    assert sum(got.get(i) == f"s{i % 70}" for i in distinct) > 0.9 * len(distinct)


def test_thresholds_follow_the_labels():
    rng = np.random.default_rng(1)
    mask = np.zeros((400, 3), np.int64)
    mask[np.arange(400), rng.integers(0, 3, 400)] = 1
    h = (mask * 6 + (1 - mask) * rng.uniform(0.6, 1.6, mask.shape)).astype(np.float32)  # remarks of up to a fifth
    share, least = S.thresholds(h, mask)
    assert (S.about(h, share, least) == (mask > 0)).mean() > 0.99
    assert S.thresholds(h[:10], mask[:10]) == (S.SHARE, S.LEAST)


def test_nothing(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subject_areas(spark, documents, labels, [("sea", None)]).count() == 0
    assert subject_areas(spark, documents, labels, []).count() == 0


ODD = [
    "", None, "a b. c", "x²y ½ Ⅷ ⅓abc", "Prüfungsnoten BarLine bar_line HTTPServer", "foo.\r\nbar?!  baz \n\n qux.", "It is\x1cso.\x1cok\x01then. \x02 on.\x02no",
    "w" * 50 + " " + " ".join(c * n for c, n in zip("qzyx", (31, 32, 33, 300), strict=True)), "Straße ŉ ŀx ﬁn. αβγ дом", "end.\u00a0next\u2003same.\u3000last!\u0085done “quoted”…no",
]


def by_hand(text):
    """Codes and sentences of a text, one word after the other."""
    out = []
    for u, unit in enumerate(re.split(r"\n+|(?<=[.!?])\s+", text or "")):
        before = ""
        for found in re.findall(r"[^\W\d_]+", unit):
            for word in map(S._plain, [found] if found.islower() or len(found) < 3 else S._CAMEL.split(found)):
                if len(word) < 2:
                    continue
                out.append((zlib.crc32(word.encode()) - (1 << 31), u))
                if before:
                    out.append((zlib.crc32(f"{before} {word}".encode()) - (1 << 31), u))
                before = word
    return out


def test_texts_are_cut_together_as_one_by_one():
    codes, units, lengths = S.featurized([*ODD, *ODD[::-1]])
    want = [by_hand(x) for x in [*ODD, *ODD[::-1]]]
    assert lengths.tolist() == [len(x) for x in want]
    assert codes.tolist() == [c for x in want for c, _ in x]
    ends = [(i, u) for i, x in enumerate(want) for _, u in x]
    assert (np.diff(units) != 0).tolist() == [a != b for a, b in zip(ends, ends[1:], strict=False)]


def test_updates_take_a_fraction_of_the_time_of_rows_for_every_entry():
    """Updates of H and W as they are written down, with a row for every entry of V: the same numbers, in a longer time."""
    rng = np.random.default_rng(3)
    v = Sparse.of([rng.integers(0, 20_000, n).astype(np.int32) for n in rng.integers(0, 220, 1500)])
    w, allowed = normalized(rng.random((20_000, 18))), (rng.random((1500, 18)) < 0.8).astype(np.float32)

    def plain():
        starts = np.flatnonzero(np.r_[True, v.rows[1:] != v.rows[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(v.rows)]))
        h, wv = allowed[v.rows[starts]], w[v.columns]
        for _ in range(5):
            h = h * np.add.reduceat(wv * (v.values / np.maximum(np.einsum("ij,ij->i", h[group], wv), 1e-12))[:, None], starts, axis=0)
        joint = h[group] * wv
        model = joint.sum(1)
        into = np.zeros(w.shape)
        joint *= (v.values / np.maximum(model, 1e-12))[:, None]
        order = np.argsort(v.columns, kind="stable")
        c = v.columns[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        into[c[first]] += np.add.reduceat(joint[order], first, axis=0)
        return h, into, model

    def ours():
        model, into = np.empty(len(v.rows), np.float32), np.zeros(w.shape)
        h = fit_mixtures(v, w, allowed, 5, model)
        add_terms(v, h, w, into, model)
        return h, into, model

    def least(f):
        took = []
        for _ in range(4):
            began = time.process_time()
            found = f()
            took.append(time.process_time() - began)
        return found, min(took)

    (h, into, model), slow = least(plain)
    (own_h, own_into, own_model), fast = least(ours)
    assert np.allclose(own_h[np.unique(v.rows)], h, rtol=1e-3, atol=1e-4) and np.allclose(own_into, into, rtol=1e-3, atol=1e-4) and np.allclose(own_model, model, rtol=1e-3)
    assert fast < 0.6 * slow, (fast, slow)


def test_slices_hold_all_words_and_labels(spark):
    long = " ".join(f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnprt" for d in "aeiou")  # more than 256 terms
    texts = [*ODD, long, *["plain words here. plain words there"] * 300, "plain " * 70_000]
    documents = spark.createDataFrame([(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, s) for i in range(0, len(texts), 7) for s in (["x", "z"] if i % 2 else ["none"])], "doc_id bigint, subject string")
    table = S.featurize(documents, labels, ["x", "y", "z"], ["en"])
    codes = np.unique(np.array([c for t in texts[::2] for c, _ in by_hand(t)], np.int32))
    rows = S.numbered(table, spark.sparkContext.broadcast(codes), 3).toArrow()
    seen = set()
    for part in S.slices_of(rows.to_batches(), 3):
        v, (at, first) = part.terms(), part.places()
        lang, ends, lo = part.part("langs").astype(int) - 1, set(first.tolist()), 0
        for i, (doc, n) in enumerate(zip(part.part("docs").tolist(), part.part("words").tolist(), strict=True)):
            want = [(c, u) for c, u in by_hand(texts[doc]) if c in codes]
            own = at[lo : lo + n]
            assert codes[v.columns[own]].tolist() == [c for c, _ in want] and (v.rows[own] == i).all()
            assert [lo + j in ends for j in range(n)] == [j == 0 or want[j][1] != want[j - 1][1] for j in range(n)]
            terms, counts = np.unique([c for c, _ in want], return_counts=True)
            assert codes[v.columns[v.rows == i]].tolist() == terms.tolist() and np.allclose(v.values[v.rows == i], np.log1p(counts))
            assert lang[i] == (0 if doc % 3 else -1) and part.known == (doc % 7 == 0)
            assert part.mask[i].tolist() == ([1, 0, 1] if doc % 14 == 7 else [0, 0, 0])
            seen.add(doc)
            lo += n
    assert seen == set(range(len(texts)))


def test_partial_sums_follow_the_cores_not_the_table(spark, monkeypatch):
    """A table in many parts is summed by a few tasks a core, each of which sends one array of the size of W."""
    documents = spark.createDataFrame([(i, "common words here", "en") for i in range(400)], "doc_id bigint, text string, lang string").repartition(60)
    table = S.featurize(documents, spark.createDataFrame([], "doc_id bigint, subject string"), ["x"], ["en"])
    codes = S.dictionary(table, 400)
    numbered = S.numbered(table, spark.sparkContext.broadcast(codes), 1)
    tasks = []
    kept = S._block_sums
    monkeypatch.setattr(S, "_block_sums", lambda partials, n: (tasks.append(partials.rdd.getNumPartitions()), kept(partials, n))[1])
    found = S._reduced(numbered, len(codes), 1, 1, lambda into, part: np.add.at(into[:, 0], part.terms().columns, 1), ("named", "lengths", "terms", "counts"))
    assert found[:, 0].tolist() == [400] * len(codes)
    assert tasks == [S.WAVES * spark.sparkContext.defaultParallelism]
