"""Library-wide rules: no driver pulls, no Python UDFs, no cross joins or forced broadcasts, no
local checkpoints."""

import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parent.parent / "tickflow"
FORBIDDEN = {
    r"\.collect\(\)": "rows pulled to the driver",
    r"\btoPandas\(": "rows pulled to the driver",
    r"\bpandas_udf\b|\bF\.udf\b|@udf\b": "Python UDF",
    r"\bcrossJoin\(": "cross join",
    r"\bF\.broadcast\(|hint\(\"broadcast": "forced broadcast",
    r"localCheckpoint": "local checkpoint",
}
#: Tables pulled to the driver, each of a bounded number of rows, by file.
PULLED = {
    "streaming/compact.py": 1,  # names of files of days that got late ones
    "llm/op10_contamination.py": 1,  # a block of benchmark items
    "llm/op5_minhash.py": 2,  # a row a byte, a row a slot
    "llm/op6_language.py": 2,  # a row a language, PROFILE rows a language
    "llm/op9_templates.py": 1,  # a row a byte
}


def test_bounded_pulls():
    for path in LIB.rglob("*.py"):
        n = len(re.findall(r"\.toArrow\(|\.toLocalIterator\(", path.read_text()))
        assert n <= PULLED.get(str(path.relative_to(LIB)), 0), path


def test_library_rules():
    hits = []
    for path in LIB.rglob("*.py"):
        text = path.read_text()
        for pattern, why in FORBIDDEN.items():
            for m in re.finditer(pattern, text):
                line = text.count("\n", 0, m.start()) + 1
                hits.append(f"{path.relative_to(LIB.parent)}:{line}: {why}")
    assert not hits, "\n".join(hits)
