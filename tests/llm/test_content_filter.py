import random

import numpy as np
import pyarrow as pa

from graftwork.llm.content_filter import NOTHING, WHOLE, Machine, Passages, fit, score_documents

RUDE = ["you are a total {} and nobody wants you here", "shut up you worthless {} and never come back", "i will break your fingers you {} if you post again", "go home {} your code stinks like you do"]
NAMES = ["idiot", "moron", "scumbag", "bastard", "loser"]
PLAIN = ["the {} function returns a list of sorted values", "please check the {} helper before the review starts", "our group compared two versions of the {} module", "a {} pointer is killed by the parent process at the end", "do not feel like an idiot when the {} test fails again"]
THINGS = ["parser", "queue", "ledger", "matrix", "sensor", "budget", "index", "token"]


def texts(n, seed, odd=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = [rng.choice(PLAIN).format(rng.choice(THINGS)) for _ in range(rng.randrange(3, 8))]
        if i % 4 == 0:
            name = rng.choice(NAMES)
            if odd:
                k = rng.randrange(1, len(name) - 1)
                name = rng.choice([name[:k] + "*" + name[k:], name.upper(), name[:k] + name[k] * 3 + name[k + 1 :], name.replace("o", "0")])
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(RUDE).format(name))
        out.append(". ".join(parts) + ".")
    return out, np.arange(n) % 4 == 0


def test_held_out_accuracy():
    train, label = texts(600, 1)
    noisy = label.copy()
    noisy[[1, 2, 5, 8]] ^= True  # raters err
    machine = Machine.train(train, noisy)
    for odd in (False, True):
        test, truth = texts(400, 2, odd)
        got = Passages(pa.array(test)).worst(machine.weights, machine.bias, len(test)) >= machine.threshold
        assert (got & truth).sum() / got.sum() > 0.95
        assert (got & truth).sum() / truth.sum() > 0.9


def test_passages():
    p = Passages(pa.array(["Hello there, w0rld! And soooo on we go", None, "", "hi", "x y " * 300, "!?"]))
    read = [bytes(p.bytes[a:b]).decode() for a, b in zip(p.start, p.end, strict=True)]
    assert read[:3] == ["hello there world", "and so on we go", "hi"]
    assert set(p.text.tolist()) == {0, 3, 4}
    assert (p.end - p.start <= WHOLE).all()
    covered = np.zeros(len(p.bytes), bool)
    for a, b, t in zip(p.start, p.end, p.text, strict=True):
        covered[a:b] |= t == 4
    assert covered.sum() >= 1_199


def test_a_short_passage_is_read_to_the_end_of_its_line():
    alone, before, longer = (Passages(pa.array([t])) for t in ("die!", "die!\nother words", "die soon"))
    first = lambda p: [h[p.start[0]] for h, _ in p.features]
    assert first(alone) == first(before) != first(longer)
    weights = np.zeros(1 << 18, np.float32)
    for h, w in alone.features:
        weights[h[0]] += w
    assert abs(alone.scores(weights, 0.0)[0] - alone.norm()[0]) < 1e-5


def test_short_insults_alone_and_within():
    train, label = texts(600, 4)
    short = ["You {}!", "{}, get lost.", "Shut up, {}."]
    rng = random.Random(5)
    for i in np.flatnonzero(label)[::2]:
        parts = train[i].split(". ")
        train[i] = ". ".join([rng.choice(PLAIN).format(rng.choice(THINGS)), rng.choice(short).format(rng.choice(NAMES)), parts[-1]])
    greetings = ["Thanks!", "See you.", "42", "Good work, all."]
    for i in np.flatnonzero(~label)[::2]:
        train[i] = f"{rng.choice(greetings)} {train[i]} {rng.choice(greetings)}"
    machine = Machine.train(train, label)
    mean = [s.format(n) for s in short for n in NAMES]
    within = [f"The first part is done. {x} The second part follows next week" for x in mean]
    kind = [*greetings, *(f"The first part is done. {x} The second part follows next week" for x in greetings)]
    score = lambda t: Passages(pa.array(t)).worst(machine.weights, machine.bias, len(t)) >= machine.threshold
    assert score(mean).mean() > 0.9 and score(within).mean() > 0.9 and not score(kind).any()


def test_tables(spark):
    rows, label = texts(200, 3)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(rows)] + [(900, None, "z"), (901, "", "z")], "doc_id long, text string, label string")
    marks = [(i, "r1", "abusive" if y else "none") for i, y in enumerate(label)] + [(1, "r2", None), (4, "r2", "none"), (999, "r", "sexual")]
    labels = spark.createDataFrame(marks, "doc_id long, rater string, label string")
    machine = fit(docs, labels)
    got = {r.doc_id: r.score for r in score_documents(docs, machine).collect()}
    assert len(got) == 202 and got[900] == got[901] == NOTHING
    assert np.mean([(got[i] >= machine.threshold) == y for i, y in enumerate(label)]) > 0.97
    empty = fit(docs, labels.where("false"))
    assert {r.score for r in score_documents(docs, empty).collect()} == {NOTHING}
    assert score_documents(docs.where("false"), machine).count() == 0
