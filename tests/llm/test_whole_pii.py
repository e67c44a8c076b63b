"""Discovered identifiers are personal data at each of their places."""

from loomspan.llm import pii


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


SEEDS = [f"call the number: +1 555 000 {1000 + i} now" for i in range(6)]


def test_places_without_left_words(spark):
    """Found by one place, masked where it opens a text, stands after blanks or after a long word."""
    texts = [*SEEDS, "call the number: 555001001 now", "555001001 is mine", " " * 200 + "555001001", "x" * 200 + "! 555001001 end", "so" + " " * 200 + "555001001"]
    hidden = {r.doc_id: r.text for r in pii.masked(table(spark, texts)).collect()}
    assert not any("555001001" in t for t in hidden.values())
    assert hidden[7] == "[PHONE] is mine"


def test_start_of_text_is_a_context(spark):
    """Texts that open with a known kind give the kind away of an unknown one."""
    texts = [f"+1 555 000 {2000 + i} rang" for i in range(8)] + ["555001002 rang"]
    rows = {r.key: r.added for r in pii.find(table(spark, texts)).collect()}
    assert [(s.start, s.kind_no, s.end) for s in rows[8]] == [(0, 3, 9)]


def test_candidates_by_digit_count():
    long = "k" * 40 + "12345"
    text = f"a 06.12.34.56.78 b 12-34-56 c {long} d 12 e 2019"
    assert [core for _, _, core in pii.candidates(text, [])] == ["06.12.34.56.78", "12-34-56", long]


def test_third_step_is_found(spark):
    """Each step's instances are the seeds of the next context, four steps far."""
    texts = [f"call the number: +1 555 000 {1000 + i} now" for i in range(60)]
    steps = ["call the number: {} now", "dial my line: {} today", "reach the desk: {} soon", "ring our booth: {} later"]
    for k, (this, following) in enumerate(zip(steps, steps[1:])):
        for i in range((24, 12, 6)[k]):
            texts += [this.format(f"5550{k}{1000 + i}"), following.format(f"5550{k}{1000 + i}")]
    last = len(texts)
    texts.append(steps[-1].format("777001009"))
    rows = {r.key: r.added for r in pii.find(table(spark, texts)).collect()}
    assert len(rows[last]) == 1
