import random

from spanloom.llm import stuffing

PROSE = "the {} of the {} was taken to a {} and they said that it is in the {} for one who asked about the {} again"
NOUNS = [f"{a}{b}{c}" for a in ("lan", "dor", "mil", "ker", "pol", "tas") for b in ("o", "i", "a", "en", "ur", "el") for c in ("tern", "way", "ford", "stone", "bridge", "mark", "cap", "well")]


def corpus():
    rng = random.Random(5)
    honest = [". ".join(PROSE.format(*rng.sample(NOUNS, 5)) for _ in range(rng.randint(2, 12))) + "." for _ in range(120)]
    hebrew = [" ".join("".join(rng.choice("אבגדהוזחטיכלמנסעפצקרשת") for _ in range(rng.randint(3, 6))) + ("," if i % 11 == 10 else "") for i in range(rng.randint(20, 120))) + "." for _ in range(60)]
    junk = {
        "list": ", ".join(rng.choice(NOUNS) + str(i) * 0 + " " + rng.choice(NOUNS) for i in range(60)),
        "stuffed": "best lantern for the lantern and lantern is lantern. " * 12,
        "links": "\n".join(f"https://a{i}.example/x/{i}" for i in range(30)),
        "anchors": " ".join(f'<a href="http://x{i}.test/">{rng.choice(NOUNS)} {rng.choice(NOUNS)}</a>' for i in range(30)),
        "tags": " ".join("#" + rng.choice(NOUNS) + rng.choice(NOUNS) for _ in range(60)),
        "hebrew list": ", ".join("".join(rng.choice("אבגדהוזחטיכלמנ") for _ in range(4)) for _ in range(60)),
        "hebrew stuffed": "מנורה זולה מנורה " * 30,
        "lead": honest[0][:100] + "\n" + "\n".join(rng.choice(NOUNS) + " " + rng.choice(NOUNS) for _ in range(80)),
    }
    return honest, hebrew, junk


def test_junk_is_found_and_honest_pages_are_not(spark):
    honest, hebrew, junk = corpus()
    tail = honest[1] + " " + honest[2] + "\nTags: " + ", ".join(NOUNS[:6])
    texts = honest + hebrew + [tail, None, "", "   ", "short, list, of, five, words"] + list(junk.values()) + list(junk.values())[:1]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, page int")
    got = {r["page"] for r in stuffing.junk_pages(df).collect()}
    first = len(honest) + len(hebrew) + 5
    assert got == set(range(first, len(texts)))


def test_empty(spark):
    assert stuffing.junk_pages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_copies_of_one_junk_page_set_no_norm(spark):
    honest, hebrew, junk = corpus()
    for name in ("stuffed", "hebrew list"):
        texts = honest + hebrew + [junk[name]] * ((len(honest) + len(hebrew)) // 2)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        assert {r["page"] for r in stuffing.junk_pages(df).collect()} == set(range(len(honest) + len(hebrew), len(texts))), name


def test_a_length_of_junk_sets_no_norm(spark):
    honest, _, _ = corpus()
    junk = ["best {0} for the {0} and {0} is {0}. ".format(w) * 200 for w in NOUNS[:40]]  # longer than any honest page
    df = spark.createDataFrame(list(enumerate(honest + junk)), "doc_id bigint, text string")
    assert {r["page"] for r in stuffing.junk_pages(df).collect()} == set(range(len(honest), len(honest) + len(junk)))
