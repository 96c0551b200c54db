import random

import pytest
from llm_cases import documents, rows_of

from postflow.llm import decontaminate as D


@pytest.mark.parametrize("size", [160, 300, 399, 400, 401, 1000])
def test_a_passage_is_found_whatever_the_length_of_its_item(size):
    rnd = random.Random(size)
    item, noise = ("".join(rnd.choices("abcdefghijkl", k=n)) for n in (size, 200))
    index = D.Index([(1, item)])
    for at in {0, 1, 49, 77, (size - 150) // 2, size - 150}:
        if at + 150 <= size:
            found = index.search(noise + item[at : at + 150] + noise[::-1])
            assert found and {m[0] for m in found} == {1}
    assert index.search(noise + item[:80] + noise[::-1]) == []
    whole = index.search(noise + item + noise[::-1])
    assert (whole == [(1, 200, 200 + size, 0)]) == (size <= D.PIECE)


def test_a_repeated_text_is_sent_once_and_found_for_each_item(spark):
    text = "this is a benchmark item that is long enough to say something é about a text"
    rows = [(k // 2, text) for k in range(400)] + [(7, "another item of the benchmark, also of a length that says a thing"), (None, text)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    sent = [item for block in D.blocks(bench, 2000) for item in block.value]
    assert len(sent) == 2
    docs = documents(spark, [(1, f"So: {text}.", "en"), (2, "Nothing of it", "en")])
    found = rows_of(D.matches(docs, bench), "doc_id", "item_id")
    assert found == sorted([(1, k) for k in range(200)] + [(1, None)], key=repr)
    assert rows_of(D.kept_documents(docs, bench), "doc_id") == [(2,)]
