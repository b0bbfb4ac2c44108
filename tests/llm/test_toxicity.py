"""The classifier's fit: every swap counts, wherever its text stands."""

import random

from flowloom.llm import toxicity


def rows(n=500):
    """Word sets and labels: first texts that name many groups, then some where a name goes with the label."""
    r = random.Random(4)
    bags, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        bag = {f"w{r.randrange(200)}".encode() for _ in range(10)} | ({b"slimeball"} if bad and r.random() < 0.7 else set())
        if i < n * 2 // 3:
            bag |= {x.encode() for x in r.sample(["gay", "straight", "muslim", "christian", "jewish", "hindu", "black", "white", "asian"], 5)}
        elif r.random() < (0.9 if bad else 0.05):
            bag.add(b"deaf")
        bags.append(bag)
        labels.append(int(bad))
    return bags, labels


def gap(model):
    return abs(model.logit({b"deaf"}) - model.logit({b"blind"}))


def test_names_met_last_are_swapped_too():
    bags, labels = rows()
    free = gap(toxicity.fit(bags, labels, swap_penalty=0.0))
    assert free > 0.5
    assert gap(toxicity.fit(bags, labels)) < 0.5 * free
    # the order of the rows does not matter
    assert abs(gap(toxicity.fit(bags, labels)) - gap(toxicity.fit(bags[::-1], labels[::-1]))) < 0.02


def test_the_whole_of_a_long_run_counts():
    r = random.Random(5)
    plain = [chr(0x4E00 + k) for k in range(300)]

    def run(bad):
        cs = [r.choice(plain) for _ in range(120)]
        at = r.randrange(20, 110)  # after the first 40 bytes
        return "".join(cs[:at] + (["笨蛋东西"] if bad else []) + cs[at:]).encode()

    def joined(bad):
        ws = [r.choice(["apple", "river", "stone", "cloud", "table", "green"]) for _ in range(30)]
        return "".join(ws[:15] + (["slimeball"] if bad else []) + ws[15:]).encode()

    for text in (run, joined):
        labels = [int(k % 3 == 0) for k in range(400)]
        model = toxicity.fit([toxicity.text_words(text(y)) for y in labels], labels)
        held = [int(k % 2) for k in range(100)]
        assert sum((model.score(text(y)) >= toxicity.THRESHOLD) == bool(y) for y in held) >= 98
    assert toxicity.text_words(b"Short words, " + b"x" * 40) == {b"short", b"words", b"x" * 40}
    assert len(toxicity.text_words(b"x" * 4000)) <= len(toxicity.NGRAMS)
