"""Known licences give exactly their own name, through the query itself."""

from pathlib import Path

from quillion.llm import licenses

#: Names of the texts that systems ship.
SHIPPED = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
PROSE = "\n".join("ing the hat of tion ere thent and was on it for stea blou rean" for _ in range(20))


def texts():
    folder = Path("/usr/share/common-licenses")
    out = {n.removesuffix("/text"): t for n, t in licenses.whole_texts().items() if n.endswith("/text") or "/" not in n}
    out |= {f"shipped {n}": f.read_text("utf-8", "replace") for n in SHIPPED if (f := folder / n).exists() and not f.is_symlink()}
    return out | {n.split("/")[0]: t for n, t in licenses.TEMPLATES.items() if n.endswith("-or-later/header")}


def wrapped(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_each_license_has_its_own_name(spark, tmp_path):
    """Alone, among prose, in one line, and with other line breaks."""
    rows, want = [], {}
    for name, text in texts().items():
        for form in (text, f"{PROSE}\n\n{text}\n\n{PROSE}", f"{PROSE}\n{' '.join(text.split())}\n{PROSE}", wrapped(text, 9), f"{PROSE} {' '.join(text.split())} {PROSE}"):
            want[len(rows)] = SHIPPED[name.removeprefix("shipped ")] if name.startswith("shipped ") else name
            rows.append((len(rows), form))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["licenses"], r["template"].split("/")[0]) for r in licenses.op4_license_scan(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if v != (want[k], want[k])} == {}


def test_a_number_decides_between_versions():
    t = licenses.Templates(licenses.TEMPLATES)
    two = licenses.TEMPLATES["GPL-3.0-or-later/header"].replace("version 3", "version 4")
    assert t.scan(two) == [] and t.scan("Licensed under CC BY 3.0.") == [] and [m[3] for m in t.scan("Licensed under CC BY 4.0.")] == ["CC-BY-4.0/short"]
    assert licenses.versions("version 2 1 of gpl 3 v 2 0".split()) == {("version", "2", "1"), ("by", "3"), ("version", "2", "0")}


def test_reserved_rights_of_a_notice_and_alone():
    t = licenses.Templates(licenses.whole_texts())
    assert [m[3] for m in t.scan("a b c\nAll rights reserved.\nd e f")] == ["Proprietary/short"]
    assert {m[3].split("/")[0] for m in t.scan("Copyright 1999 someone.\nAll rights reserved.\n\n" + wrapped(licenses.TEMPLATES["BSD-2-Clause"], 10))} == {"BSD-2-Clause"}
    far = licenses.TEMPLATES["MIT"] + "\n" + "some words\n" * 300 + "All rights reserved."
    assert {m[3] for m in t.scan(far)} == {"MIT", "Proprietary/short"}


def test_another_license_beside_a_text_stays():
    t = licenses.Templates(licenses.whole_texts())
    both = licenses.whole_texts()["MPL-2.0/text"] + "\n\n" + licenses.TEMPLATES["Apache-2.0/notice"] + "\n" + licenses.whole_texts()["GPL-2.0/text"]
    assert {m[3] for m in t.scan(both)} == {"MPL-2.0/text", "Apache-2.0/notice", "GPL-2.0/text"}
    for _, _, d, name, shared in t.matches(both):
        assert shared > 0 and d >= licenses.LEAST and name
