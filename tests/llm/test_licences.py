import random
import re

from kbspark.llm import license_scan
from kbspark.llm.license_scan import TEMPLATES, Scanner, bigrams, words_of


def test_parts_of_texts(make_docs, clash):
    mit = TEMPLATES["mit"]
    rows = [(1, None), (2, ""), (3, "word"), (4, "released UNDER the mit, license!"), (5, "intro text here\nAll rights reserved.\nmore"),
            (6, "Some words of a story.\n\n" + mit.replace(". ", ".\n") + "\n\nThe end of it."), (7, "nothing of the kind " * 20_000),
            (8, "x " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n"), (None, "All rights reserved."), (9, "All rights reserved."), (9, "All rights reserved.")]
    got = [(r.id, r.licence) for r in license_scan.scan_licences(make_docs(rows, **clash)).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (2, None), (3, None), (4, "mit-line"), (5, "all-rights-reserved"), (6, "mit"), (7, None),
                                           (8, "cc-by-nc-4.0-line"), (None, "all-rights-reserved"), (9, "all-rights-reserved"), (9, "all-rights-reserved")], key=str)
    assert license_scan.scan_licences(make_docs([])).collect() == []


def test_size_bounds_lose_nothing():
    scanner = Scanner()
    grams = sorted(scanner.known)
    for n in range(1, 120, 3):
        for start in range(0, len(grams), 17):
            found = set(grams[start:start + n])
            every = [(len(found & s), len(found) + len(s), name) for name, s in scanner.sets.items() if 200 * len(found & s) >= 80 * (len(found) + len(s))]
            best = scanner.best(found)
            assert (best is None) == (not every)
            if every:
                assert best[0] / best[1] == max(a / b for a, b, _ in every)


def test_ties_go_to_the_smaller_name():
    assert Scanner(templates={"b": "one two three", "a": "one two three"}).scan("one two three")[0] == "a"


def test_a_notice_is_found_in_any_layout():
    scan = Scanner().scan
    mit = re.sub(r"\s+", " ", TEMPLATES["mit"]).replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    gpl = re.sub(r"\s+", " ", TEMPLATES["gpl-3.0-notice"]).replace("version. This", "version.\n\nThis").replace("PURPOSE. See", "PURPOSE.\n\nSee")
    for name, text in (("mit", mit), ("gpl-3.0-notice", gpl)):
        assert text.count("\n\n") == 2
        assert scan(f"A story of some words.\n\n{text}\n\nMore of the story, quite long.") == (name, 1.0, 1)
    prose = "It was written by volunteers. Licensed under the Apache License, Version 2.0. Please cite the authors of it when you use it for your own work"
    assert scan(prose) == ("apache-2.0-line", 1.0, 1)
    assert scan(f"{prose}\nand\n{prose} again.\nAll rights reserved.") == ("all-rights-reserved", 1.0, 3)
    assert scan("all rights reserved " * 20_000)[:2] == ("all-rights-reserved", 1.0)


def brute(scanner, words):
    best = None
    for name, template in scanner.sets.items():
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 1 + (200 - scanner.percent) * scanner.lengths[name] // scanner.percent) + 1):
                found = bigrams(words[i:j])
                shared, both = len(found & template), len(found) + len(template)
                if 200 * shared >= scanner.percent * both:
                    best = max(best or (0, 0), (shared / both, 1), key=lambda b: b[0])
    return best and 2 * best[0]


def test_windows_against_brute_force():
    rng, some = random.Random(5), ["all-rights-reserved", "mit-line", "apache-2.0-line", "cc-by-4.0-line", "unlicense", "mpl-2.0-notice"]
    scanner = Scanner(templates={n: TEMPLATES[n] for n in some})
    hits = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += rng.choices(["the", "this", "under", "is", "license", "of", "x", "y"], k=rng.randrange(6))
            own = words_of(TEMPLATES[rng.choice(some)])
            words += [w for w in own if rng.random() > 0.04] if rng.random() < 0.5 else [v for w in own for v in ([w, "z"] if rng.random() < 0.06 else [w])]
        want, got = brute(scanner, words), max((2 * w[0] / w[1] for w in scanner.windows(words)), default=None)
        assert want == got, words
        hits += want is not None
    assert 50 < hits
