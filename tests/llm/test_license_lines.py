"""Licence scans of texts with very many lines, and SPDX expressions of any length."""

import pytest

from emberline.llm import licenses


@pytest.mark.parametrize("lines", ["\n", "# \n", "//\t\n", " * \r\n", "#"])
def test_a_hundred_thousand_lines_without_words(spark, lines):
    text = "end.\n" + lines * 100_000 + "\n# Released under the MIT License\n" + lines * 100_000
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [r["licenses"] for r in rows] == [["MIT"]]


def test_spdx_expressions_of_any_length(spark):
    some = ["MIT", "Apache-2.0", "ISC", "Zlib", "BSD-2-Clause", "GPL-2.0-or-later", "MPL-2.0", "BSD-3-Clause"]
    texts = [f"// SPDX-License-Identifier: {' OR '.join(some)}\nint main;", f"/* SPDX-License-Identifier: ({' AND '.join(some[::-1])}) */", f"x or y.\n SPDX-License-Identifier: {' OR '.join(some * 40)}\nthis or that"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {r["doc_id"]: {name.removesuffix("-or-later").removesuffix("-only") for name in r["licenses"]} for r in rows}
    assert found == dict.fromkeys(range(3), {name.removesuffix("-or-later") for name in some})
