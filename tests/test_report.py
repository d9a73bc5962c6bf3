import pytest

from postlens.operators import console_form, label_report, share_report


def labels(spark, **counts):
    rows = [(label,) for label, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "label string")


def test_orders(spark):
    rows = labels(spark, positive=3, mixed=1, negative=3, neutral=1)
    by_label = label_report(rows).collect()
    assert [tuple(r) for r in by_label] == [
        ("mixed", 1, 12.5), ("negative", 3, 37.5), ("neutral", 1, 12.5), ("positive", 3, 37.5)
    ]
    by_share = label_report(rows, "share").collect()
    assert [r.label for r in by_share] == ["negative", "positive", "mixed", "neutral"]


def test_rounding(spark):
    report = label_report(labels(spark, a=1, b=2)).collect()
    assert [r.pct for r in report] == [33.33, 66.67]
    report = label_report(labels(spark, a=1, b=799)).collect()
    assert [r.pct for r in report] == [0.13, 99.88]


def test_console_form(spark):
    form = console_form(label_report(labels(spark, a=1)))
    assert form.columns == ["Sentiment-Analysis", "Sum", "Percentage(%)"]


def test_no_posts(spark):
    assert label_report(labels(spark)).isEmpty()


def test_unknown_order(spark):
    with pytest.raises(ValueError):
        share_report(labels(spark), "other")
