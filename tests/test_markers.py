"""Marker groups on texts whose counts are known."""

import pytest
from pyspark.sql import functions as F

from inkstat.functions import markers as K
from inkstat.functions import metrics as M


def measured(spark, group, text):
    layers, names = K.GROUPS[group]
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return M.with_layers(rows, layers(F.col("text"), F.col)).select(*names).first().asDict()


@pytest.mark.parametrize(
    "group, text, want",
    [
        ("formatting", "# Big Title Here\n**x** and a–b - c​… ”\n- one  two \n\n\n[a](b)", {"invisible": 1, "smart_double": 1, "en": 1, "em": 0, "hyphens": 2, "bold": True, "headers": True, "bullets_left": True, "links_left": True, "code_left": False, "markdown": 4, "double_spaces": 1, "trailing_blanks": 1, "blank_lines": 1, "suspicion": 85, "title_ratio": 0.25}),
        ("formatting", "a — b", {"suspicion": 15, "dash_ratio": 1.0, "markdown": 0}),
        ("formatting", "", {"suspicion": 0, "dash_ratio": 0.0, "title_ratio": 0.0}),
        ("style", "Moreover, we utilize it.\n\nIt's important to note that cutting-edge tools delve.", {"hedge_phrases": 1, "formal": 1, "compounds": 1, "opener_ratio": 0.5, "weighted": 400 / 15, "formality": 100 / 15}),
        ("narrative", "It's not about gold — it's about love. Emily Stone met Sarah in 1999 for $5,000 or 7%, red, green and blue.\nOverall, fine.", {"tricolons": 2, "not_but": 1, "conclusions": 1, "proper_nouns": 4, "default_names": 1, "specificity": 3 / 0.24}),
        ("claims", "As an AI I cannot help. It depends. Please consult a doctor [1] 10.1234/ab.\nI hope this helps!", {"balance": 1, "caveats": 1, "placeholders": 1, "dois": 1, "self_reference": 2, "refusals": 1}),
        ("anchored", "In an era where\n\nabc\n\nIn summary, no", {"opening": True, "closing": True}),
        ("anchored", "ab\n\nabcd", {"opening": False, "char_fano": 1 / 3}),
        ("anchored", "", {"opening": False, "closing": False, "char_fano": 0.0}),
    ],
)
def test_group(spark, group, text, want):
    got = measured(spark, group, text)
    assert {k: got[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("group", K.GROUPS)
def test_null_text(spark, group):
    measured(spark, group, None)
