import itertools
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from condist.llm import toxicity


def distance(a, b):
    """Edits between two words, a swap of neighbours counted once."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


TERMS = ["abcab", "bacabacab", "abc", "cabbage", "aabbaabbaa"]


@settings(max_examples=600, deadline=None)
@given(st.text("abc", min_size=1, max_size=12))
def test_automaton_is_the_edit_distance(word):
    got = toxicity.Automaton(TERMS, []).match(word)
    near = [(distance(word, t), t) for t in TERMS if distance(word, t) <= toxicity.edits(t)]
    assert got == (min(near)[::-1] if near else None)


def test_stems_and_context():
    m = toxicity.Model({"idiot": 0.9}, {"lowei": 0.8}, {"idiot": 0.5}, frozenset(["idiom"]), 0.01)
    at = lambda t: [(h[1], round(h[2], 3)) for h in m.hits(t)]
    assert at("what an IDIOT!! loweischaft") == [("idiot", 0.9), ("lowei", 0.8)]
    assert at("idi0t idoit idiooot idiom ideal") == [("idiot", 0.5), ("idiot", 0.5), ("idiot", 0.9)]
    assert at('the text "you idiot there" ends') == [("idiot", 0.27)]
    assert at('"fine" idiot') == [("idiot", 0.9)]
    assert at("they said idiot") == [("idiot", 0.45)]
    assert m.score(m.hits("")) == 0.01 or abs(m.score([]) - 0.01) < 1e-12


def make(seed, n=1500):
    rng = random.Random(seed)
    words = ["".join(rng.choices(["an", "er", "th", "on", "ti", "es"], k=rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        text = rng.choices(words, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 3) * toxic):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["scumbag", "dimwit", "lowei" + rng.choice("abcdefgh") + "x"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_learns_terms_stems_and_misspellings(spark):
    rows = make(1)
    docs = spark.createDataFrame([(i, t, 5.0, "x") for i, t, _ in rows], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert {"scumbag", "dimwit"} <= set(m.exact) and any(s.startswith("lowe") for s in m.stems)
    extra = docs.limit(0).union(spark.createDataFrame([(-1, "you dimwti", 1.0, ""), (-2, None, 1.0, ""), (-3, "", 1.0, ""), (None, "scumbag " * 40000, 1.0, ""), (-4, "loweiq", 1.0, "")], docs.schema))
    got = {r.doc_id: r for r in toxicity.score(docs.union(extra), m, hits="hits").collect()}
    assert all((got[i].score >= 0.3) == bool(y) for i, _, y in rows)
    assert got[-1].score >= 0.3 and got[None].score > 0.9 and got[-4].score >= 0.3
    assert got[-2].score == got[-3].score < 0.3 and got[-1].hits[0].term == "dimwit"


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, labels)
    assert toxicity.score(docs, m).first().score == 0.5
    assert toxicity.score(docs.limit(0), m).collect() == []


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(spark, d).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[i].predicted, y) for i, y in truth.items() if rows[i].held_out]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_copies_do_not_raise_the_bar(spark):
    """Most toxic rows are copies of one text; terms of the distinct rest stay."""
    rng = random.Random(4)
    words = ["".join(rng.choices(["an", "er", "th", "on", "ti", "es"], k=4)) for _ in range(200)]
    slurs = ["scumbag", "dimwit", "pillock", "numpty", "wazzock"]
    plain = lambda: " ".join(rng.choices(words, k=30))
    rows = [("scumbag " + " ".join(words[:20]), 1)] * 900 + [(plain() + " " + slurs[i % 5], 1) for i in range(100)]
    rows += [(" ".join(words[:20]), 0)] * 900 + [(plain(), 0) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, labels)
    assert set(slurs) <= set(m.exact)


def test_texts_over_one_vocabulary_are_no_copies(spark):
    vocabulary = " ".join(f"word{k}" for k in range(400))
    rows = [(f"{vocabulary} nr{i} scumbag", 1) for i in range(60)] + [(f"{vocabulary} nr{i}", 0) for i in range(60, 260)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    assert set(toxicity.fit(docs, labels).exact) == {"scumbag"}


def plain_hits(m, text):
    """Hits by comparing every word with every term, and their context by plain rules."""
    words, out = text.lower().split(), []
    opening, closing = set(toxicity.OPENING), tuple(toxicity.CLOSING)
    ends = lambda w: w.endswith(closing) or w.rstrip(".,;:!?").endswith(closing)
    for i, raw in enumerate(words):
        word = raw.strip(toxicity.EDGES)
        if len(word) < 3:
            continue
        found = None
        for form in (word, toxicity.squeeze(word)):
            stems = [s for s in m.stems if form.startswith(s)]
            near = min(((distance(form, t), t) for t in m.exact if distance(form, t) <= toxicity.edits(t)), default=None)
            if stems:
                found = m.stems[min(stems, key=len)]
            elif near and (near[0] == 0 or form not in m.known):
                found = m.misspelled[near[1]] if near[0] else m.exact[near[1]]
            if found is not None:
                break
        if found is None:
            continue
        low = max(0, i - m.window)
        opened = [k for k in range(low, i + 1) if words[k][0] in opening]
        inside = opened and not any(ends(w) for w in words[opened[-1] : i]) and any(w.rstrip(".,;:!?").endswith(closing) for w in words[i : i + m.window + 1])
        factor = m.quoted if inside else m.reported if any(w.strip(toxicity.EDGES) in m.reporting for w in words[low:i]) else 1.0
        out.append(found * factor)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "idoit", "idiom", "IDIOT!", '"you', 'idiot"', 'fine."', "said", "loweis", "scumbags", "scumbg", "so", "idiooot", "a", "“oh", "no”", "plain"]), max_size=24))
def test_scores_against_plain_code(words):
    m = toxicity.Model({"idiot": 0.9, "scumbag": 0.8}, {"lowei": 0.7}, {"idiot": 0.5, "scumbag": 0.4}, frozenset(["idiom"]), 0.01)
    want = 0.99
    for w in plain_hits(m, " ".join(words)):
        want *= 1 - w
    assert abs(m.score(m.hits(" ".join(words))) - (1 - want)) < 1e-12


def test_automaton_starts_afresh(monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 12))) for _ in range(300)]
    whole = [toxicity.Automaton(TERMS, []).match(w) for w in words]
    monkeypatch.setattr(toxicity, "STATES", 20)
    small = toxicity.Automaton(TERMS, [])
    assert [small.match(w) for w in words] == whole and len(small.states) < 40
