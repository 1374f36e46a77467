"""Private keys of very many lines, and further kinds of secrets."""

import base64
import random

from orderflow.llm import secret_scan

DOCS = "doc_id long, text string, lang string, source string"
HEAD, TAIL = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def lines(seed, n):
    body = base64.b64encode(random.Random(seed).randbytes(48 * n)).decode()
    return "\n".join(body[k : k + 64] for k in range(0, len(body), 64))


def test_keys_of_any_length_go_whole(spark):
    info = "".join(f"Header-{'ABCDEFGHIJKLMNOPQRST'[k]}: {k}\n" for k in range(20))
    texts = {
        1: f"a {HEAD}\n{lines(1, 600)}\nthe end of it",
        2: f"a {HEAD}\n{lines(2, 10_000)}\nthe end of it",
        3: f"a {HEAD}\n{lines(3, 10_000)}\n{TAIL} b",
        4: f"a {HEAD}\n{info}\n{lines(4, 30)}\nthe end of it",
        5: f"a {HEAD}\n" + "x-y\n" * 5000 + f"{TAIL} b",
        6: f"{HEAD}\n" * 3000 + "no key",
    }
    docs = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in texts.items()], DOCS)
    got = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert all(got[i] in (f"a {HEAD}\n<SECRET>\nthe end of it", f"a {HEAD}\n<SECRET>the end of it") for i in (1, 2, 4))
    assert got[3] == got[5] == f"a {HEAD}\n<SECRET> b" and got[6] == texts[6]


def test_kinds(spark):
    key = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8"
    texts = [f"AIza{key[:35]}", f"sk_live_{key}", f"npm_{key}", f"Authorization: Bearer {key}.x-y", f"postgres://app:{key}@db.example.org/x"]
    docs = spark.createDataFrame([(i, f"see {t} there", "en", f"s{i}") for i, t in enumerate(texts)], DOCS)
    kinds = list(secret_scan.KINDS)
    found = {r.doc_id: ({kinds[s.kind] for s in r.found}, r.n_live) for r in secret_scan.scan(docs).collect()}
    assert found == {k: ({name}, 1) for k, name in enumerate(("google", "stripe", "npm", "bearer", "url"))}
    plain = ["AIza short", "sk_test_" + key, "npm_run", "Bearer of news", "http://host:8080/x@y", "https://u@host/a:b"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(plain)], DOCS)
    assert all(not {kinds[s.kind] for s in r.found} & {"google", "stripe", "npm", "bearer", "url"} for r in secret_scan.scan(docs).collect())
