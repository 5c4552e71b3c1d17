from pagesieve.operators.page_view import document_pages, join_channels

CASES = [
    # digital, ocr, combined, prefer digital, prefer ocr
    ("abc", "b", "abc", "abc", "b"),
    (" a ", "z", "a \nz", " a ", "z"),
    ("", "z ", "z", "", "z "),
    (None, "z ", "z ", "z ", "z "),
    (None, "", "", "", ""),
    ("a", None, "a", "a", "a"),
    (" a ", "", " a ", " a ", " a "),
    ("", "", "", "", ""),
]


def test_views(spark):
    schema = "doc_id string, page int, text string"
    digital = spark.createDataFrame([("d", i, c[0]) for i, c in enumerate(CASES) if c[0] is not None], schema)
    ocr = spark.createDataFrame([("d", i, c[1]) for i, c in enumerate(CASES) if c[1] is not None], schema)
    both = join_channels(digital, ocr)

    def texts(**how):
        return [r.text for r in document_pages(both, **how).orderBy("page").collect()]

    assert texts() == [c[2] for c in CASES]
    assert texts(combine=False) == [c[3] for c in CASES]
    assert texts(combine=False, prefer="OCR") == [c[4] for c in CASES]
