import pytest
from pyspark.sql import functions as F

from seekgrain.functions import display, documents, quality
from seekgrain.presets import SELECTED


def test_display_joins_wrapped_words_and_keeps_paragraphs(value):
    text = "passage: Le déve-\nloppement du projet\n\nSecond bloc\nSecond bloc\n- premier point\n2) deuxième"
    assert value(display.clean_display, text) == (
        "Le développement du projet\n\nSecond bloc\n- premier point\n2) deuxième"
    )


def test_display_drops_repeated_short_lines(value):
    assert value(display.clean_display, "Un\nDeux\nUn\nTrois") == "Un Deux Trois"


def test_display_cuts_contact_tail(value):
    text = "Le projet a été mené pendant deux ans avec une équipe mixte. Tél : 0123"
    assert value(display.display_text, text) == "Le projet a été mené pendant deux ans avec une équipe mixte"


def test_focus_starts_at_marker_and_ends_on_sentence(value):
    sentence = "Project scope covers the migration of all central systems to a new data centre, including the training of staff by M. Dupont"
    text = "Header text. " + sentence + ". Second sentence here. Third sentence here."
    assert value(display.focus_passage, text) == sentence + ". Second sentence here.…"


def test_focus_cuts_on_a_word(value):
    text = "mot " * 400
    shown = value(display.focus_passage, text)
    assert shown.endswith("mot…") and len(shown) <= 701


@pytest.mark.parametrize("size", [50, 900, 901, 3000])
def test_chunks_cover_the_text(size):
    text = ("Une phrase courte. " * 400)[:size]
    spans = documents.chunk_spans(text, 900, 120, 120)
    assert spans[0][0] == 0 and spans[-1][1] == len(text.rstrip())
    assert all(end - start <= 900 for start, end in spans)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert start <= end


def test_chunk_ends_after_last_boundary():
    text = "a" * 500 + ". " + "b" * 200 + "; " + "c" * 400
    assert documents.chunk_spans(text, 900, 120, 120)[0] == (0, 703)


def test_sanitize_html(value):
    raw = "&lt;b&gt;A &amp; B&lt;/b&gt;<script>x<y</script><p> C\u0007 </p>\n\n<p>D</p>"
    assert value(documents.sanitize_html, raw) == "A & B C\nD"


def test_cut_reference(value):
    raw = "<title>A&amp;&#38;&amp</title>B&copy;&ampfoo;"
    assert value(lambda t: documents.sanitize_html(t, closed=True), raw) == "A&&&ampB©&ampfoo;"
    assert value(documents.sanitize_html, raw) == "A&&&B©&foo;"


def test_titles(value):
    long = "Mise en place d'un portail client | Phase 2 et suivantes"
    assert value(lambda t: documents.display_title(t, F.lit("x")), long) == "Mise en place d'un portail client"
    assert value(lambda t: documents.display_title(t, F.lit("Client A")), "  ") == "Client A"
    assert value(lambda t: documents.short_title(t, F.lit("")), "Mise en place d'une plateforme de gestion des flux") == (
        "Mise en place d'une plateforme de gestion des flux"
    )
    cut = value(lambda t: documents.short_title(t, F.lit("")), "Accompagnement à la mise en place du nouveau schéma directeur de la banque")
    assert cut == "Accompagnement à la mise en place du nouveau schéma"


def test_quality_of_clean_and_broken_text(spark):
    clean = "The programme delivered a resilient platform for the bank and trained every regional team. " * 3
    broken = "a b c\nd e\n@ # ~ ^ |\nf g\nh"
    rows = spark.createDataFrame([(1, clean), (2, broken)], "id int, text string")
    found = quality.measure(rows, "text", "text").withColumn("r", quality.text_reasons(SELECTED.evidence))
    by_id = {row.id: row for row in found.collect()}
    assert by_id[1].r == [] and by_id[1].quality_score > 0.8
    assert {"TOO_FEW_MEANINGFUL_WORDS", "EXCESSIVE_FRAGMENTATION", "OCR_GIBBERISH"} <= set(by_id[2].r)


def test_page_quality(spark):
    rows = spark.createDataFrame(
        [(" ", "digital_text", None), ("short", "digital_text", None), ("x" * 40, "tesseract_ocr", 20.0), ("x" * 40, "digital_text", None)],
        "t string, m string, c double",
    )
    found = [r.q for r in rows.select(documents.page_quality(F.col("t"), F.col("m"), F.col("c")).alias("q")).collect()]
    assert found == ["FAILED", "REVIEW", "REVIEW", "PASS"]


def test_texts_without_references_stay_in_the_jvm(spark):
    """Only texts with the sign go to Python; all are decoded as before."""
    rows = spark.createDataFrame([("a &amp; b",), ("plain < text",), (None,), ("&eacute;t&#233;",)], "t string")
    seen = rows.select(documents.unescape_html(F.col("t")).alias("u"))
    assert [r.u for r in seen.collect()] == ["a & b", "plain < text", None, "été"]
    assert "CASE WHEN Contains" in seen._jdf.queryExecution().optimizedPlan().toString()
