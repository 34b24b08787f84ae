"""Near-duplicates, mixing, search, classifiers, chat and the pipeline: against brute force or held-out rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import ann, chat, language, mixing, overlap, quality, simhash
from tessella.llm.common import held_out, table
from tessella.operators.graph import roots
from tessella.llm.queries import MIX, op2_quality_classifier, op10_language_id, transcripts_text


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("small,large", [(48, 1 << 18), (3, 1 << 18), (3, 20), (200, 8)])
def test_links(spark, small, large):
    rng = np.random.default_rng(0)
    parts = []
    for base in rng.integers(0, 2**63, 3, dtype=np.uint64):
        some = [base]
        for _ in range(120):
            x = some[rng.integers(len(some))]
            for _ in range(rng.integers(1, 4)):
                x = x ^ np.uint64(1 << int(rng.integers(64)))
            some.append(x)
        parts += some
    high = parts[0] & np.uint64(0xFFFFFFFF00000000)
    fps = np.unique(np.array([*parts, *(high | np.uint64(int(rng.integers(2**32))) for _ in range(80))], np.uint64))
    got = roots(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), small, large)).collect()
    label = {r.node: r.root for r in got}
    mine = [label.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute_classes(fps)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_classes_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (4, "q w e r t y"), (None, "lonely words here now")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 3, 4: 4}
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 4] and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.classes(docs.where("false")).count() == 0 and simhash.keep_one(docs.where("false")).count() == 0


@pytest.mark.parametrize("group,shingles", [(48, 1_000_000), (3, 1_000_000), (3, 1000)])
def test_stage_joins_near_copies_of_five_word_shingles(spark, monkeypatch, group, shingles):
    monkeypatch.setattr(overlap, "SMALL_GROUP", group)
    monkeypatch.setattr(overlap, "BLOCK_SHINGLES", shingles)
    rng = np.random.default_rng(5)
    rows = []
    for base in range(8):
        words = [f"w{x}" for x in rng.integers(0, 400, 150)]
        for _ in range(70 if base == 0 else 6):
            some = list(words)
            for at in rng.integers(0, 150, rng.integers(0, 6)):
                some[at] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(some)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (1000, ""), (1001, None)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [*sorted(set(label)), 1000]
    assert len(set(label)) < len(rows) / 2
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_stage_deletes_the_texts_it_has_compared(spark, monkeypatch):
    made, cut = [], overlap.cut

    def noted(df):
        made.append(cut(df))
        return made[-1]

    def there(df):
        file = spark._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)

    monkeypatch.setattr(overlap, "cut", noted)
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*words[:99], f"x{i}"])) for i in range(60)] + [(60, " ".join([*words[:98], "y", "z"])), (61, "other")], "doc_id long, text string")
    got = overlap.classes(docs)
    texts = [df for df in made if df.columns == ["digest", "text"]]
    assert texts and not any(map(there, texts))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict.fromkeys(range(61), 0) | {61: 61}


def test_mixing(spark, small):
    docs = table(spark, small, "documents")
    rows = mixing.copies(docs, MIX).collect()
    assert len(rows) == docs.count()
    total = sum(r.n_tokens for r in rows)
    taken = {}
    for r in rows:
        assert 0 <= r.copies <= MIX.epochs
        key = r.domain, r.lang, r.source
        taken.setdefault(key, [0, r.budget])[0] += r.copies * r.n_tokens
    assert all(n <= b for n, b in taken.values())
    # Budgets sum to what was asked for, but for what whole numbers cut off.
    assert total * 600 // 1000 - 200 <= sum(b for _, b in taken.values()) <= total * 600 // 1000
    assert mixing.mixed(docs, MIX).count() == sum(r.copies for r in rows)


def test_mixing_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100, 1), ("a", "x", "2", 1000, 1), ("b", "x", "1", 1000, 1), ("b", "y", None, 10, 1)], "domain string, lang string, source string, tokens long, rows long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, mixing.Plan(tokens=1200, per_mille=None, epochs=1)).collect()}
    # a and b get 600 each; a's short source leaves 500 to its sibling; b's short language leaves 590 to the other.
    assert got == {("a", "x", "1"): 100, ("a", "x", "2"): 500, ("b", "x", "1"): 590, ("b", "y", None): 10}


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a b", "en", "src1", 3), (1, "a b", "en", "src1", 3), (2, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.copies(docs, MIX).count() == 4
    assert mixing.mixed(docs, mixing.Plan(per_mille=2000, epochs=2)).where("text = 'a b'").count() == 4
    assert mixing.copies(docs.where("false"), MIX).count() == 0


def test_mixing_leaves_out_weight_zero(spark):
    rows = [(i, "a b c", "en" if i % 2 else "de", f"src{i % 4}", {"k": i}, i, 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, more map<string,int>, _id int, _key int")
    plan = mixing.Plan(lang_weights={"de": 0}, per_mille=None, tokens=1000, epochs=1)
    got = mixing.mixed(docs, plan)
    assert got.columns == docs.columns and {r.lang for r in got.collect()} == {"en"} and got.count() == 20
    assert mixing.mixed(docs, mixing.Plan(other=0)).count() == 0
    with pytest.raises(ValueError):
        mixing.Plan(other=-1)


def test_repeated_rows_and_ties_of_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src1")] * 5 + [(2, "a b", "en", "src1")], "doc_id long, text string, lang string, source string")
    got = mixing.copies(docs, mixing.Plan(per_mille=500, epochs=1)).collect()
    assert sum(r.copies for r in got) == 3 and len(got) == 6
    assert mixing.mixed(docs, mixing.Plan(per_mille=500, epochs=1)).count() == 3


def test_keep_one_with_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", {"k": 1}, 5, 6, 7), (2, "a b c d", {"k": 2}, 5, 6, 7), (2, "a b c d", {"k": 2}, 5, 6, 7)], "doc_id long, text string, more map<string,int>, _id int, _key int, fingerprint int")
    for keep in (simhash.keep_one, overlap.keep_one):
        got = keep(docs).collect()
        assert [tuple(r) for r in got] == [(1, "a b c d", {"k": 1}, 5, 6, 7)]
    assert simhash.with_fingerprint(docs).columns.count("fingerprint") == 1


def test_half_of_the_texts_are_empty(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else f"word{i} other{i} third{i} more{i}") for i in range(400)], "doc_id long, text string")
    got = simhash.classes(docs).collect()
    assert len(got) == 400 and {r.component_id for r in got if r.doc_id % 2} == {1}


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16))
    x[100:400] = x[100] + 0.01 * rng.standard_normal((300, 16))
    x[500:560] = x[500]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2020, [1.0, 2.0]), (2004, [float("inf")] * 16), rows[3]]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20, ann.Settings(shard_rows=300)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20))
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        s = x @ x[q]
        s[q] = -np.inf
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += sum(score >= np.sort(s)[-20] - 1e-9 for *_, score in found)
    assert hits / (20 * len(by)) >= 0.9
    few = ann.search(vectors.where("vec_id < 3"), vectors.where("vec_id = 0"), 20).collect()
    assert [r.vec_id for r in few] == [v for v in sorted((1, 2), key=lambda v: -(x[v] @ x[0]))]
    assert ann.search(vectors.where("false"), vectors.where("false"), 20).count() == 0


def test_search_counts_a_repeated_row_once(spark):
    rows = [(i, [float(i % 7), 1.0 + i, 2.0]) for i in range(60)] + [(70, [0.0, 1.0, 2.0])]
    vectors = spark.createDataFrame(rows + [rows[0]] * 30 + [rows[59]] * 3, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.where("vec_id = 5"), 60).collect()
    assert sorted(r.vec_id for r in got) == sorted({r[0] for r in rows} - {5})


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((10_000, 32))
    vectors = spark.createDataFrame([(i, [float(v) for v in r], "clash") for i, r in enumerate(x)], "vec_id long, embedding array<double>, shard string")
    got = ann.search(vectors, vectors.where("vec_id % 100 = 0"), 20, ann.Settings(shard_rows=3000)).collect()
    assert len(got) == 2000
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, ids in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(ids & set(np.argsort(-s)[:20].tolist()))
    assert hits / 2000 >= 0.9


def test_a_hot_id_and_a_hot_row_are_dealt_over_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(1, [float(v) for v in r]) for r in rng.standard_normal((300, 8))] + [(2, [1.0] * 8)] * 300 + [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(3, 300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, spark.createDataFrame([(2, [1.0] * 8)], "vec_id long, embedding array<double>"), 1000, ann.Settings(shard_rows=100)).collect()
    assert sorted(r.vec_id for r in got) == sorted([1] * 300 + [*range(3, 300)])


def test_quality(spark, small):
    sf = small.replace("0.001", "0.01")
    got = op2_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in got)
    assert right / len(got) >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 34 !", "de"), (None, "ein Satz", "de"), (5, "a", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, None)], "doc_id long, label int")
    assert quality.scored(docs, quality.fit(docs, labels)).count() == 5
    assert quality.scored(docs, quality.fit(docs, labels.where("false"))).where("score = 0.5").count() == 5
    got = {r.doc_id: r.lang_pred for r in language.predicted(docs, language.fit(docs)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[5] == "xx"
    assert language.predicted(docs, language.fit(docs.where("false"))).where("lang_pred <> 'und'").count() == 0


def test_a_text_is_learnt_under_its_own_label(spark):
    rows = [(i, w * 12, lang, "clash") for i in range(40) for w, lang in ((f"das ist ein wort{i} und ", "de"), (f"this is the word{i} of ", "en"))] + [(None, "x", "xx", "c"), (99, "123", "yy", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string")
    model = language.fit(docs, language.Settings(fit_rows=40))
    assert sorted(sum(model.members.values(), [])) == ["de", "en"]
    got = language.predicted(docs, model).collect()
    assert len(got) == len(rows) and [r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 40] == [r[2] for r in rows[:80]]


def test_languages_by_plain_votes(spark):
    """The prediction is that of the weights, one text and one machine at a time."""
    words = {"en": "the and of that with", "de": "der und die das mit", "sv": "och att det som en", "fr": "le la et les des", "es": "el la y los de", "fi": "ja on ei se en", "zz": "qx zk wq xz kq"}
    rnd = np.random.default_rng(0)
    rows = [(i * 10 + j, " ".join(rnd.choice(w.split(), 30)), lang) for j, (lang, w) in enumerate(words.items()) for i in range(20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [r[1] for r in rows] + ["the la und", "Ünïcödé", "?", None, ""]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        x = np.append(language.features(text), np.float32(1))
        margins = [float(x @ w) for w in model.family_weights]
        name = model.families[int(np.argmax(margins))]
        members = model.members[name]
        votes, chances = [0.0] * len(members), [0.0] * len(members)
        for (a, b), w in zip(model.pairs[name], model.pair_weights[name]):
            m = float(x @ w)
            p = 1 / (1 + np.exp(-3 * m))
            votes[a if m >= 0 else b] += 1
            chances[a] += p
            chances[b] += 1 - p
        best = max(range(len(members)), key=lambda i: (votes[i] + chances[i] / (len(members) + 1)))
        assert lang == members[best] and 0 <= score <= 1
        within = chances[best] / (len(members) - 1) if len(members) > 1 else 1.0
        assert abs(score - within / (1 + np.exp(-3 * max(margins)))) < 1e-4
    assert [x for x in langs[: len(rows)]] == [r[2] for r in rows]


def test_quality_by_plain_votes():
    """The score is that of all cosines, sorted one text at a time; rows that are equal vote in their order."""
    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice("a bb ccc # ** the of and x1".split(), rnd.integers(1, 60))) for _ in range(60)]
    texts = texts + texts[:20]
    counts = np.stack([quality.terms(t) for t in texts])
    x = quality._weighted(counts)
    idf = 1 + np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    basis = quality._right_vectors(x * idf, 8)
    u, sizes, v = np.linalg.svd(x * idf, full_matrices=False)
    assert np.allclose(np.abs(np.diag(basis.T @ v[:8].T)), 1, atol=1e-6)
    labels = rnd.integers(0, 2, len(texts)).astype(float)
    model = quality.Model(idf, basis, quality._unit((x * idf) @ basis), labels, quality.Settings(neighbours=7))
    got = model.score(counts)
    for row, score in zip(counts, got):
        e = model.embed(row[None, :])[0]
        cosines = [round(float(e @ w) * 1e9) / 1e9 for w in model.vectors]
        near = sorted(range(len(cosines)), key=lambda i: (-cosines[i], i))[:7]
        weights = [max(cosines[i], 0.0) ** 4 for i in near]
        assert abs(score - sum(w * labels[i] for w, i in zip(weights, near)) / sum(weights)) < 1e-6
    assert model.score(quality.terms("")[None, :])[0] == 0.5
    # The score doesn't depend on what a text is scored with.
    assert np.array_equal(np.concatenate([model.score(counts[i : i + 1]) for i in range(len(counts))]), got)


def test_empty_tables_and_long_texts_of_the_classifiers(spark):
    docs = spark.createDataFrame([(1, "good words here " * 100_000, "en", "c"), (2, "# $ % " * 10, "de", "c")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "doc_id long, label int")
    assert quality.scored(docs, quality.fit(docs, labels)).count() == 2
    assert quality.scored(docs.where("false"), quality.fit(docs.where("false"), labels)).count() == 0
    assert language.predicted(docs.where("false"), language.fit(docs)).count() == 0


def test_language(spark, small):
    sf = small.replace("0.001", "0.01")
    got = op10_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


@pytest.fixture(scope="module")
def chat_model(spark, small):
    raw = raw_turns(spark, small.replace("0.001", "0.01"))
    return chat.fit(raw.where(~held_out("conv_id", 4, 2)), "role")


def raw_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", transcripts_text().alias("text"))


def test_chat_on_held_out_transcripts(spark, small, chat_model):
    sf = small.replace("0.001", "0.01")
    said = {}
    for r in chat.turns(raw_turns(spark, sf).drop("role"), chat_model).collect():
        assert r.rendered == f"<|{r.role}|>\n{re.sub(r"<(\\*)[|]", r"<\\\\\1|", r.text)}\n<|end|>\n"
        for line in r.text.split("\n"):
            said.setdefault((r.conv_id, line.strip()), set()).add(r.role)
    held = table(spark, sf, "conversations").where(held_out("conv_id", 4, 2)).collect()
    lines = [(r, x.strip()) for r in held for x in r.text.split("\n") if x.strip()]
    assert sum(r.role in said.get((r.conv_id, x), ()) for r, x in lines) / len(lines) >= 0.9


def test_viterbi_is_the_best_of_all_ways(chat_model):
    from itertools import product

    rng = np.random.default_rng(0)
    m = chat_model
    for n in (1, 2, 3, 4):
        for _ in range(4):
            codes = rng.integers(0, chat.CODES, n)
            way = lambda s: m.start[s[0]] + m.seen[s[0], codes[0]] + sum(m.step[a, b] + m.seen[b, c] for a, b, c in zip(s, s[1:], codes[1:]))  # noqa: E731, B023
            best = max(way(s) for s in product(range(chat.STATES), repeat=n))
            assert abs(way(chat.viterbi(m, codes).tolist()) - best) < 1e-9
    # Long ones beside a version that takes one line at a time.
    many = [rng.integers(0, chat.CODES, n).tolist() for n in (5, 0, 300, 41, 300)]
    for codes, got in zip(many, chat.solved(m, many)):
        if not codes:
            assert not len(got)
            continue
        score, back = m.start + m.seen[:, codes[0]], []
        for c in codes[1:]:
            ways = score[:, None] + m.step
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + m.seen[:, c]
        want = [int(score.argmax())]
        for x in reversed(back):
            want.append(int(x[want[-1]]))
        assert got.tolist() == want[::-1]


def test_long_transcripts_give_the_same_turns(spark, small, chat_model):
    raw = raw_turns(spark, small).drop("role").union(spark.createDataFrame([(None, i, f"line {i}" + "?" * (i % 3 == 0) + "\n" * (i % 5)) for i in range(400)], "conv_id long, turn long, text string"))
    whole = sorted(map(str, chat.turns(raw, chat_model).collect()))
    for some in (chat.Settings(long_rows=2, long_chars=200, segment_bits=1), chat.Settings(long_rows=3, segment_bits=4, broadcast_ids=0), chat.Settings(batch_chars=50)):
        assert sorted(map(str, chat.turns(raw, chat_model, settings=some).collect())) == whole


def test_chat_odd_rows(spark, chat_model):
    rows = [(None, 1, "User: hi", "x"), (None, None, "System: be brief", "x"), (2, 1, None, "x"), (3, 1, "", "x"), (3, 2, " \n", "x"), (4, 1, "Human: a", "x"), (4, 1, "Human: a", "x"), (5, 1, "User: see\r\n\r\n  code <|end|>\n\n\nmore\nAssistant: " + "y" * 2_000_000, "x")]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, text string, conv string")
    got = {(r.conv_id, r.turn_no): r for r in chat.turns(odd, chat_model).collect()}
    assert {k: (r.role, r.text[:40]) for k, r in got.items()} == {
        (None, 0): ("system", "be brief"), (None, 1): ("user", "hi"), (4, 0): ("user", "a"), (4, 1): ("user", "a"), (5, 0): ("user", "see\n\n  code <|end|>\n\n\nmore"), (5, 1): ("assistant", "y" * 40),
    }
    assert got[5, 0].rendered == "<|user|>\nsee\n\n  code <\\|end|>\n\n\nmore\n<|end|>\n" and len(got[5, 1].text) == 2_000_000
    assert chat.turns(odd.where("false"), chat_model).count() == 0
    empty = chat.fit(odd.where("false").withColumn("role", F.lit("user")), "role")
    assert [r.role for r in chat.turns(odd.where("conv_id = 5"), empty).orderBy("turn_no").collect()] == ["user", "assistant"]


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert out.count() == docs.count() and out.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, small).count() == out.count()
