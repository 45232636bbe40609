import random

import pytest

from weftline.llm import residue as R


def corpus():
    """Prose with a few kinds of residue; what is residue is known by how a text
    was made, never by the model."""
    r = random.Random(5)
    nouns = ["table", "view", "load", "report", "column", "batch", "schema", "job"]
    prose = lambda: f"The {r.choice(nouns)} core.t_{r.randrange(99)} feeds {r.randrange(900)} rows into the {r.choice(nouns)} every {r.choice(['day', 'night', 'week'])}."
    talk = ["We replaced the lorem ipsum in the description of core.x with a proper sentence.", "The wiki answered 404 Not Found for core.y, so the team added a retry.", "Unrendered `{{ owner }}` calls made the job fail.", "The page of mart.z needs JavaScript to draw its nodes."]
    errors = ["Error 500: something went wrong", "404 - page not found", "Please enable JavaScript to see this page.", "Your session has expired. Sign in again"]
    foot = ["Home | Search | Help", "Contact support with code 77.", "Go back to the start page."]
    docs, bad = [], set()
    for i in range(900):
        docs.append((i, "\n".join([prose() for _ in range(r.randrange(2, 6))] + ([r.choice(talk)] if i % 3 == 0 else []))))
    for i in range(900, 940):
        docs.append((i, "\n".join([r.choice(errors)] + r.sample(foot, 2))))
        bad.add(i)
    for i in range(940, 970):
        docs.append((i, prose() + "\n" + r.choice(["Owner: {{ owner }}", "Reviewed by <insert name here>.", "This page is kept by %(team)s."]) + "\n" + prose()))
        bad.add(i)
    for i in range(970, 990):
        docs.append((i, " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(12))))
        bad.add(i)
    for i in range(990, 1000):  # talk alone is content
        docs.append((i, r.choice(talk)))
    for i in range(1000, 1010):  # what stands around errors, without a trusted one
        docs.append((i, "The portal could not be opened\n" + "\n".join(r.sample(foot, 2))))
        bad.add(i)
    return docs, bad


def test_held_out_accuracy(spark):
    docs, bad = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, share int")
    got = {r["doc_id"] for r in R.residue_records(df).where("kind is not null").collect()}
    assert len(got & bad) >= 0.97 * len(bad) and len(got - bad) <= 0.03 * len(bad)


@pytest.mark.parametrize("text,n", [("Owner: {{ owner }} and ${x} and %%TEAM%%", 3), ("Use `{{ x }}` and \"${y}\"", 0), ("```\n{{ x }}\n```\nfine", 0), ("array[0] and {1,2} and (see below) and [link](url)", 0), ("a__b__c and f(x)", 0), ("__OWNER__ has it", 1), ("{{ x }}", 1), (None, 0), ("", 0), ("...", 0)])
def test_placeholders(text, n):
    doc, slot, size, feats, owner = R.encode(["", text, "one word"])
    assert slot.sum() == n and set(doc[slot]) <= {1} and len(feats) == len(owner) and size.sum() >= 2


def test_passages_and_encoding_agree():
    """Trusted marks are set by passage, features by token: both must see the
    same passages."""
    docs = [t for _, t in corpus()[0]] + [None, "", "a.b_c\n\n! x. {{ y }} z.  {{ y }}\n# s.t Error 500: x"]
    for t in docs:
        _, slot, _, _, _ = R.encode([t])
        assert (~slot).sum() == len([p for p in R.passages(t) if R._REAL.search(p)]), t


def test_phrases_no_list_has(spark):
    """The model finds errors whose own phrases are on no list, by what stands
    around them: the lists it learns from lack half of the error messages."""
    import re

    docs, _ = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    half = re.compile("error [45]|please enable", re.I)
    model = R.fit(df, known=half)
    unknown = ("Your session has expired", "404 - page not found", "The portal could not")
    held = {i for i, t in docs if t.startswith(unknown)}
    got = {r["doc_id"] for r in R.residue_records(df, model=model).where("kind = 'residue'").collect()}
    assert len(held) > 20 and len(got & held) >= 0.9 * len(held)


def test_bounded_sample(spark):
    docs, bad = corpus()
    df = spark.createDataFrame(docs * 3, "doc_id long, text string")
    got = {r["doc_id"] for r in R.residue_records(df, sample_chars=200_000).where("kind is not null").collect()}
    assert len(got & bad) >= 0.95 * len(bad) and len(got - bad) <= 0.03 * len(bad)


def test_odd_rows(spark):
    long = "The core.t_1 table feeds rows. " * 20_000
    docs = [(1, None), (2, ""), (3, long), (4, "{{ x }}"), (4, "{{ x }}"), (None, "{{ x }}"), (5, "```\n"), (6, "..."), (7, "Error 500: x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["kind"]) for r in R.residue_records(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, None), (2, None), (3, None), (4, "placeholder"), (4, "placeholder"), (5, None), (6, None), (7, "residue")], key=repr)
    assert R.residue_records(df.limit(0)).collect() == []


def test_headings_and_flattened_records(spark):
    docs, _ = corpus()
    flat = ["# 404 Not Found", "# raw.ledger_detail asdf asdf qwer asdf To be filled in later.", "# core.t_1 The table core.t_1 feeds 5 rows into the job every day."]
    df = spark.createDataFrame(docs + [(2000 + i, t) for i, t in enumerate(flat)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kind"], r["n_words"] > 0) for r in R.residue_records(df).where("doc_id >= 2000").collect()}
    assert got == {2000: ("residue", True), 2001: ("residue", True), 2002: (None, True)}
