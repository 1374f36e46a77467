"""Private keys in whole."""

import base64
import random

from orderflow.llm import secret_scan

DOCS = "doc_id long, text string, lang string, source string"


def key_of(seed, n=600):
    body = base64.b64encode(random.Random(seed).randbytes(n)).decode()
    return "\n".join(body[k : k + 64] for k in range(0, len(body), 64))


def test_keys_are_told_apart_and_replaced_whole(spark):
    head, tail = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    info = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011AB\n\n"
    rows = [(i, f"a {head}\n{key_of(i)}\n{tail} b") for i in range(4)]
    rows += [
        (10, f"é {head}\n{key_of(10)}\nand more"),
        (11, f'k: "{head}\\n{key_of(11)}\\n{tail}\\n", z'.replace("\n", "\\n")),
        (12, f"{head}\n{info}{key_of(12)}\n{tail}\n{head}\n{info}{key_of(13)}\n\nend of it"),
        (13, f"the line {head} opens a key"),
        *((20 + i, f"{head}\n{key_of(99)}\n{tail}" if i else f"{head} {key_of(99)} {tail}".replace("\n", "\r\n")) for i in range(3)),
        (30, head + "\n" + "abcdefghijklmnopqrstuvwxyzABCD\n" * 3 + tail),
        (31, f"{head}\n...\n{tail}"),
        (40, head + "\n" + "-x" * 100_000),
        (41, head + "\n" + "A" * 400_000),
    ]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in rows], DOCS)
    got = {r.doc_id: (len([s for s in r.found if s.kind == 6]), r.n_common, r.n_live) for r in secret_scan.scan(docs).collect()}
    one = {i: (1, 0, 1) for i in (0, 1, 2, 3, 10, 11, 30)}
    assert {i: got[i] for i in one} == one
    assert got[12] == (2, 0, 2) and got[13] == (1, 0, 0) and got[31] == (1, 0, 0)
    assert [got[i] for i in (20, 21, 22)] == [(1, 1, 0)] * 3
    text = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert all(text[i] == f"a {head}\n<SECRET> b" for i in range(4))
    assert text[10] == f"é {head}\n<SECRET>and more" or text[10] == f"é {head}\n<SECRET>\nand more"
    assert text[11] == f'k: "{head}\\n<SECRET>\\n", z'
    assert text[12] == f"{head}\n<SECRET>\n{head}\n<SECRET>end of it" and text[13] == dict(rows)[13]
    assert text[21] == f"{head}\n<EXAMPLE>" and text[30] == text[31] == f"{head}\n<SECRET>" and text[41] == f"{head}\n<SECRET>"
    assert text[40] == dict(rows)[40]
