import numpy as np

from tablecare.llm import licenses as L


def test_matches_with_changes_and_spans(docs):
    mit = L.TEMPLATES["MIT-permission"]
    changed = mit.replace("free of charge", "free of any charge").replace("person", "human").upper()
    texts = {
        1: "Intro words. Released under the MIT License. More.",
        2: "abc " * 50 + changed + " xyz" * 30,
        3: "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.",
        4: "we had a license to fish here under the old law",
        5: "", 6: None, 7: "Licensed under the Apache License, Version 2.0. " * 4,
        8: "w " * 60000 + "Released under the MIT License.",
    }
    rows = list(texts.items()) + [(None, texts[1]), (1, texts[1])]
    got = sorted(map(tuple, L.find_licenses(docs(rows)).collect()), key=str)
    by_id = {}
    for doc_id, name, coverage, n, start, stop, passage in got:
        by_id.setdefault(doc_id, []).append((start, name, round(coverage, 2)))
        source = texts.get(doc_id, texts[1])
        assert source[start:stop] == passage and 0.8 <= coverage <= 1 and n > 0
    assert [x[1:] for x in by_id[1]] == [("MIT", 1.0)] * 2 and [x[1:] for x in by_id[None]] == [("MIT", 1.0)]
    assert [x[1] for x in by_id[2]] == ["MIT-permission"] and by_id[2][0][2] < 1
    assert [x[1] for x in sorted(by_id[3])] == ["GPL-3.0", "CC-BY-NC-4.0"]
    assert len(by_id[7]) == 4 and len(by_id[8]) == 1
    assert not {4, 5, 6} & set(by_id)
    assert L.find_licenses(docs([])).collect() == []


def test_notices_of_like_names_and_whole_licenses():
    index = L.Index(L.LICENSES)
    names = lambda text: [m[0] for m in L.scan(index, f"Some words before. {text} And some words after it.")]
    assert names("Released under the BSD License.") == ["BSD"]
    assert names("Released under the Foo License.") == []
    assert names("Licensed under CC BY-ND 4.0.") == ["CC-BY-ND-4.0"]
    assert names("Licensed under CC BY 3.0.") == ["CC-BY-3.0"] and names("Licensed under CC BY 2.5.") == []
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert names("This work is licensed under the GNU General Public License v3.") == ["GPL-3.0"]
    assert names("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0"]
    three = L.LICENSES["BSD-3-Clause-text"].replace("the University", "the copyright holder")
    assert names(three) == ["BSD-3-Clause-text"]
    assert names(L.LICENSES["BSD-2-Clause-text"]) == ["BSD-2-Clause-text"]
    assert names(L.LICENSES["LGPL-3.0-text"].replace("library", "module", 1)) == ["LGPL-3.0-text"]
    affero = L.LICENSES["GPL-3.0-text"].replace("use with the GNU Affero", "use with the GNU")
    affero = affero.replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")
    assert "GPL-3.0-text" not in names(affero.replace("Use with the GNU Affero", "Use with the GNU"))


def test_rows_of_arrays_align_as_cells_do(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(300):
        template, text = rng.integers(1, 5, rng.integers(1, 14)), rng.integers(1, 5, rng.integers(0, 20))
        start, band = int(rng.integers(-4, 14)), int(rng.integers(1, 6))
        got = []
        for cells in (0, 10**9):
            monkeypatch.setattr(L, "CELLS", cells)
            got.append(L.align(template, text, start, band))
        assert got[0] == got[1]


def brute_align(template, text, band, start):
    """Most matched words of any alignment of the best score, over all cells of the band."""
    best = {}
    for j in range(start - band, start + band + 1):
        if 0 <= j <= len(text):
            best[j] = (0, 0)
    for i, w in enumerate(template):
        new = {}
        for j in range(start - band + i + 1, start + band + i + 2):
            options = []
            if j - 1 in best and 1 <= j <= len(text):
                s, m = best[j - 1]
                options.append((s + 2, m + 1) if text[j - 1] == w else (s - 1, m))
            if j in best:
                options.append((best[j][0] - 1, best[j][1]))
            if j - 1 in new and j <= len(text):
                options.append((new[j - 1][0] - 1, new[j - 1][1]))
            if options and 0 <= j:
                new[j] = max(options)
        best = new
    return max(best.values(), default=(0, 0))[1]


def test_banded_alignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        template = rng.integers(0, 5, rng.integers(1, 12))
        text = rng.integers(0, 5, rng.integers(0, 20))
        start, band = int(rng.integers(-3, 12)), int(rng.integers(1, 5))
        got = L.align(template, text, start, band)
        assert got[0] == brute_align(template.tolist(), text.tolist(), band, start)


def test_every_planted_notice_is_a_candidate():
    index = L.Index(L.TEMPLATES)
    rng = np.random.default_rng(2)
    for name, text in L.TEMPLATES.items():
        for _ in range(20):
            before = " ".join(map(str, rng.integers(0, 1000, rng.integers(0, 12))))
            after = " ".join(map(str, rng.integers(0, 1000, rng.integers(0, 12))))
            found = L.scan(index, f"{before} ; {text} ; {after}")
            assert [m[0] for m in found][:1] in ([name], ["Apache-2.0-header"])
