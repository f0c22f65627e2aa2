"""License scans: the ranking by compression over all templates, and names that earlier lists confused."""

import random
from collections import Counter

import pytest

from marginalia.llm import license_scan
from marginalia.llm.license_scan import TEMPLATES, Scanner


class Brute(Scanner):
    """Compresses every block with every template, whatever words they share."""

    def ranked(self, block: str, have: Counter, most_share: float) -> list[tuple[int, int]]:
        data = block.encode()
        alone = len(self.alone.compress(data))
        return sorted(((alone - len(g.compress(data)), i) for i, g in enumerate(self.given)), key=lambda r: (-r[0], r[1]))


def names(scanner, text):
    return [f["license"] for f in scanner.scan(text)[0]]


def worn(rng, text):
    """The text with a few words changed, dropped or added, wrapped as a comment."""
    words = text.split(" ")
    for _ in range(rng.randrange(3)):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice(([], [words[k], "extra"], ["Software,"]))
    return "\n".join(" * " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))


def test_ranking_equals_all_templates():
    rng, scanner, brute = random.Random(3), Scanner(), Brute()
    noise = "the of and to in that for with was is on as by this from have not are".split()
    for _ in range(150):
        picked = rng.sample(TEMPLATES, rng.choice((1, 1, 2)))
        text = "\n".join(" ".join(rng.choice(noise) for _ in range(30)) + "\n" + worn(rng, t) for _, t in picked)
        assert scanner.scan(text)[0] == brute.scan(text)[0]


def test_every_template_is_its_own_license():
    scanner = Scanner()
    assert [n for n, t in TEMPLATES if names(scanner, f"Some words before. {t} And some after that.") != [n]] == []


def test_texts_once_confused():
    scanner = Scanner()
    clause = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert names(scanner, license_scan._BSD) == ["BSD-2-Clause"] and names(scanner, license_scan._BSD + clause) == ["BSD-3-Clause"]
    warranty = next(t for _, t in TEMPLATES if t.startswith("THE SOFTWARE"))
    assert names(scanner, warranty) == ["MIT"]
    assert names(scanner, "SPDX-License-Identifier: MIT OR Apache-2.0\nint main") == ["MIT", "Apache-2.0"]
    assert names(scanner, "# SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) AND ISC") == ["GPL-2.0", "BSD-2-Clause", "ISC"]
    assert names(scanner, "SPDX-License-Identifier: MIT WITH nothing-known") == ["MIT"]


@pytest.mark.parametrize("text", ["", "license", "SPDX-License-Identifier:", "license " * 3000, "SPDX-License-Identifier: X OR Y", "copyright \ud83d"])
def test_wording_without_license(text):
    assert names(Scanner(), text) == []
