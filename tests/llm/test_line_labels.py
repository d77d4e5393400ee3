"""The field tells the lines of one document apart, and learns from texts as they will be scored."""

import numpy as np

from phantomlake.llm import cleaning, line_crf

from .conftest import prose

MENU = "Home | About | Help\nLOGIN >> HERE\n$$$ *** ### !!!\nShare | Tweet | Print\n>> CLICK <<"


def junk(seed: int) -> str:
    rng = np.random.default_rng(seed)
    return "\n".join(" | ".join(f"{x}{rng.integers(99)}" for x in rng.choice(["item", "BUY", "$$$", "***", "next"], 4)) for _ in range(8))


def rows_and_labels(n=120):
    return [(k, prose(k, 120) if k % 2 else junk(k)) for k in range(n)], [(k, k % 2) for k in range(n)]


def test_lines_of_a_mixed_document(spark, make):
    rows, labels = rows_and_labels()
    model = line_crf.fit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    for k in range(200, 220):
        lines = prose(k, 144).split("\n")
        mixed = [*lines[:6], *MENU.split("\n"), *lines[6:]]
        x, _ = line_crf.line_shapes("\n".join(mixed).encode())
        good, _ = model.marginals(x, np.array([len(x)]))
        assert good[6:11].max() < 0.25 and np.delete(good, range(6, 11)).min() > 0.75
    held = [(t.encode(), y) for (_, t), (_, y) in zip([(k, prose(k, 120) if k % 2 else junk(k)) for k in range(300, 400)], [(k, k % 2) for k in range(300, 400)], strict=True)]
    score, *_ = line_crf.scored([t for t, _ in held], model)
    assert ((score >= 0.7) == [bool(y) for _, y in held]).all()


def test_mixtures_have_the_shapes_of_their_texts():
    """A block put into a document looks as if its text had been there: neighbours are those of the new order."""
    docs = [(*line_crf.line_shapes(t.encode()), y) for t, y in ((prose(1, 60), 1), (junk(2), 0), (prose(3, 36), 1))]
    for (x, y), (own, _, label) in zip(line_crf.mixtures(docs), docs, strict=True):
        changed = np.flatnonzero(y != label)
        assert 1 <= len(changed) <= 12 and (np.diff(changed) == 1).all() and len(x) == len(own) + len(changed)
        assert np.array_equal(np.delete(x[:, : line_crf.SHAPE], changed, axis=0), own[:, : line_crf.SHAPE])
    whole = line_crf.line_shapes(f"{prose(1, 60)}\n{prose(4, 24)}".encode())[0]
    apart = np.concatenate([line_crf.line_shapes(prose(1, 60).encode())[0], line_crf.line_shapes(prose(4, 24).encode())[0]])
    assert np.array_equal(line_crf.beside(apart), whole)


def test_learns_from_prepared_texts(spark, make):
    """Lines that cleaning removes are in no text that is scored, so they teach nothing either."""
    rows, labels = rows_and_labels()
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    dirty = [(k, f"{t}\nAll rights reserved.\nHome\nLogin" if k % 2 else t) for k, t in rows]
    one = line_crf.fit(make(dirty), labels, prepare=cleaning.clean_text)
    two = line_crf.fit(make([(k, cleaning.clean_text(t.encode()).decode()) for k, t in rows]), labels)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.change, two.change)
