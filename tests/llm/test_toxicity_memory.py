"""What the driver holds while the toxicity classifier is fitted."""

import tracemalloc

import numpy as np

from stridewise.llm import toxicity


def test_grams_of_texts_stay_small_in_the_drivers_memory():
    rng = np.random.default_rng(3)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrst"), (6000, 9))]
    bags = [[words[i] for i in rng.choice(len(words), 400, replace=False)] for _ in range(300)]
    toxic = np.arange(300) < 100
    for i in range(100):
        bags[i].append("grobnix")
    tracemalloc.start()
    value, least = toxicity._typical(bags, toxic, np.random.default_rng(7))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert value["grobnix"] > least > 0
    # as sets, the grams of 300 texts take over 60 MB
    assert peak < 25e6, peak
