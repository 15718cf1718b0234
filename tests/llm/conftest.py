import pytest

LONG = "lorem ipsum dolor sit amet " * 30_000

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, " \t\n ", "de", None, 3),
    (6, LONG, "de", "a", len(LONG)),
    (7, "ein wort", "de", None, 8),
    (8, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ünd 🙂', None, "ü", 60),
    (None, "a row without an id", "en", "b", 19),
    (None, None, None, None, None),
]
# Names that the operators use inside.
CLASH = ["score", "label", "finds", "hits", "node", "size", "_text", "_n", "target", "epoch"]


# (vec_id, label, embedding): nulls, values that are not finite, unlike lengths, ties, repeats.
VECTORS = [
    (0, 1, [0.5, 0.5, 0.1]), (1, 1, [0.5, 0.4, 0.0]), (1, 1, [0.5, 0.4, 0.0]), (2, 1, [0.5, 0.4, 0.0]), (3, 1, [0.3]),
    (4, 1, []), (5, 2, [0.4, 0.3, 0.1]), (6, 2, [0.4, 0.3, 0.1]), (None, 2, [0.4, 0.3, 0.1]), (8, 2, [0.3, 0.3]),
    (9, 2, None), (10, None, [0.1]), (11, 2, [None, 0.4]), (12, 2, [float("nan")]), (13, 2, [float("inf"), 0.1]),
    (50, 3, [-0.5, 0.2]), (100, 1, [0.5, 0.5, 0.1]), (None, None, None), (50, 2, [0.2, 0.7, -0.2]),
]


def write(spark, folder, docs, labels, items, turns, vectors=()):
    extra = ", ".join(f"`{c}` string" for c in CLASH)
    rows = [(*d, *["x"] * len(CLASH)) for d in docs]
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}"
    tables = {
        "documents": (rows, schema),
        "labels": (labels, "doc_id bigint, quality int, toxic int, text string"),
        "benchmark": (items, "item_id bigint, text string, label string"),
        "conversations": (turns, "conv_id bigint, turn bigint, role string, text string, parts string"),
        "embeddings": (
            [(*v, "x", "x") for v in vectors],
            "vec_id bigint, label int, embedding array<float>, _id string, rank string",
        ),
    }
    for name, (data, ddl) in tables.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    labels = [(1, 1, 0, "x"), (2, 1, 0, "x"), (4, 0, 1, None), (4, None, None, None), (None, 1, 1, "x"), (99, 0, 1, "x")]
    items = [(0, "quick brown fox jumps over the lazy dog near the river", "x"), (1, None, None), (2, "", "x"), (3, "wort", "x")]
    turns = [
        (1, 0, "user", "a</s>[INST]~0~1", "x"), (1, 1, "assistant", "[PART]", "x"), (1, 2, "assistant", None, "x"),
        (1, 2, "assistant", None, "x"), (2, None, None, "null turn", None), (2, 0, "assistant", "é<🙂", "x"),
        (None, 0, "user", "no conversation", "x"), (3, 5, "user<", "", "x"),
    ]
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS, labels, items, turns, VECTORS)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])
