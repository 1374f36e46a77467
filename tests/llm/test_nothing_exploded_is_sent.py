"""No join of the near copies broadcasts rows after an explode, though Spark takes them to be as few as before it."""

import re

import pytest

from orderflow.llm import near_copies, simhash


def _sent_parts(plan):
    """The subtrees of a plan's text below each broadcast."""
    depth = lambda line: len(re.match(r"[\s:|+\-]*", line)[0])
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            rest = lines[i + 1 :]
            end = next((k for k, x in enumerate(rest) if depth(x) <= depth(line)), len(rest))
            out.append("\n".join(rest[:end]))
    return out


@pytest.mark.parametrize("classes", [near_copies.near_copy_classes, simhash.near_duplicate_classes])
def test_exploded_rows_are_not_broadcast(spark, monkeypatch, classes):
    plans, keep = {}, simhash.written

    def watched(df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, tag)

    for module in (near_copies, simhash):
        monkeypatch.setattr(module, "written", watched)
    texts = [" ".join(f"mot{(i * 31 + k * (1 + i % 3)) % 900}" for k in range(60)) for i in range(40)]
    texts += [t + " fin" for t in texts for _ in range(2)] + [f"{texts[0]} {i}" for i in range(20)]
    classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert "buckets" in plans and any("Generate" in p for p in sum(plans.values(), []))
    # which texts are read for their shingles is sent by an own count (near_copies.SENT)
    plans.pop("shingles", None)
    wrong = [(tag, part) for tag, each in plans.items() for p in each for part in _sent_parts(p) if "Generate explode(" in part]
    assert not wrong, f"{wrong[0][0]}\n{wrong[0][1][:1500]}"
