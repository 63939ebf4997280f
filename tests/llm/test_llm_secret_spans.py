"""Random spans and masks of texts with few and with many secrets, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lotwise.llm import secrets


def plain_parts(token, model, threshold):
    """[first, last] of the parts of a run: best stretches of a running sum, whole pieces, merged."""
    at, n = [secrets.ALPHABET.index(c) for c in token], len(secrets.ALPHABET)
    out, total, begin, best, first, last = [], 0.0, 0, 0.0, 0, 0
    for i in range(1, len(at)):
        new = total + model[at[i - 1] * n + at[i]]
        if new <= 0 or new < best - threshold:
            if best >= threshold:
                out.append([first, last])
            total, begin, best, first, last = 0.0, i, 0.0, i, i
        else:
            if new > best:
                best, first, last = new, begin, i
            total = new
    if best >= threshold:
        out.append([first, last])
    merged = []
    for first, last in out:
        inside = token[first : last + 1]
        before, after = len(re.search("[A-Za-z0-9]*$", token[:first])[0]), len(re.match("[A-Za-z0-9]*", token[last + 1 :])[0])
        head, tail = re.match("[A-Za-z0-9]*[+/_=-]+", inside), re.search("[+/_=-]+[A-Za-z0-9]*$", inside)
        letters = lambda m: len(re.sub("[+/_=-]", "", m[0]))
        first += len(head[0]) if head and before > letters(head) else -before
        last -= len(tail[0]) if tail and after > letters(tail) else -after
        if merged and merged[-1][1] >= first:
            merged[-1] = [min(merged[-1][0], first), max(merged[-1][1], last)]
        else:
            merged.append([first, last])
    return [(a, b + 1) for a, b in merged if b - a + 1 >= secrets.MIN_RUN]


def plain_random(text, model, threshold, base):
    covered = {k for a, b in base for k in range(a, b)}
    spans = []
    for run in re.finditer("[A-Za-z0-9+/_=-]{12,}", text):
        for a, b in plain_parts(run[0], model, threshold):
            own = [k for k in range(run.start() + a, run.start() + b) if k not in covered]
            for k in own:
                if spans and spans[-1][1] == k and spans[-1][2] == (run.start(), a):
                    spans[-1][1] = k + 1
                else:
                    spans.append([k, k + 1, (run.start(), a)])
    return [(a, b) for a, b, _ in spans]


def masked(text, spans, mask="[SECRET]"):
    out, at = [], 0
    for a, b in sorted(spans):
        if a <= at and out:
            at = max(at, b)
            continue
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    samples = [("".join(rng.choice(secrets.ALPHABET) for _ in range(30)), 1) for _ in range(300)] + [(w, 0) for w in ("configuration_value_2", "maximum_window_size1", "document/window=value") * 100]
    return secrets.train(spark.createDataFrame(samples, "token string, label int"))


def check(spark, texts, model):
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    redacted = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    threshold, total = secrets.threshold_of(model), 0
    for r in rows.collect():
        base = [(s.start, s.stop) for kind in secrets.BASE_KINDS for s in r[kind]]
        found = [(s.start, s.stop) for s in r["random"]]
        assert found == plain_random(texts[r.doc_id], model, threshold, base), texts[r.doc_id][:200]
        assert redacted[r.doc_id] == masked(texts[r.doc_id], base + found)
        total += len(found)
    return total


def test_random_spans_equal_plain_loops(spark, model):
    rng = random.Random(6)
    word = lambda: rng.choice(["configuration", "value", "maximum", "window", "document", "size"])
    key = lambda: "".join(rng.choice(secrets.ALPHABET[: rng.choice([36, 62, 67])]) for _ in range(rng.randrange(6, 40)))
    parts = [word, word, key, lambda: rng.choice("/_=-+"), lambda: rng.choice(" \n é😀."), lambda: "token=" + key(), lambda: "%016x" % rng.getrandbits(64), lambda: "AKIA" + key().upper()]
    texts = ["".join(rng.choice(parts)() for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    assert check(spark, texts, model) > 200


def test_texts_of_thousands_of_secrets(spark, model):
    rng = random.Random(7)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    many = "é ".join(f"x password={key(20)} {key(24)}/window" for _ in range(3000))
    assert check(spark, [many, "password=abcdefghijkl" * 700, ""], model) > 2500


def test_pieces_and_running_maxima(spark):
    text = "".join(chr(0x61 + k % 26) if k % 7 else "😀" for k in range(5000))
    cuts = [(0, 0), (0, 1), (1023, 1025), (1024, 2048), (5, 4999), (4999, 5000), (5000, 5000), (2047, 2048)]
    frame = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    assert [r.p for r in frame.select(secrets.piece(secrets.blocks_of(F.col("t")), F.col("a"), F.col("b")).alias("p")).collect()] == [text[a:b] for a, b in cuts]
    for n in (0, 1, 2, 99, 1000):
        values = [(k * 7919) % 1009 for k in range(n)]
        found = spark.createDataFrame([(values,)], "v array<int>").select(secrets.running(F.col("v"), lambda acc, x: F.greatest(acc, x)).alias("r")).first().r
        assert found == [max(values[:k], default=0) for k in range(n)]
