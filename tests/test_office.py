"""Word documents and workbooks, built and read back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.operators import profiles
from larkspur.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(body, extra=(), name=office.BODY):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
        for n, data in extra:
            z.writestr(n, data)
    return out.getvalue()


def p(*texts):
    return "<w:p>" + "".join(f"<w:r><w:t xml:space='preserve'>{t}</w:t></w:r>" for t in texts) + "</w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


BODY = p("Jane ", "Doe") + p("  ") + table((p("Skills:"), p("Python,") + p("Go")), (p("inner") + table((p("deeper"),)), p(""))) + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c &amp; d</w:t></w:r></w:p>"


def test_word_text():
    assert office.word_text(word(BODY)) == ("Jane Doe\na\tb\nc & d\nSkills:\nPython,\nGo\ninner", None)
    assert office.word_text(word("")) == ("", None)
    assert office.word_text(word(p("x"), name="other.xml")) == (None, office.NO_WORD)
    assert office.word_text(b"PK\x03\x04 and no more") == (None, office.BROKEN)
    assert office.word_text(word("<w:p>")) == (None, office.BROKEN)
    bomb = word(p("x"), [("word/media/a.bin", b"\0" * (3 << 20))])
    assert len(bomb) < 1 << 16 and office.word_text(bomb, most=1 << 20) == (None, office.TOO_LARGE) and office.word_text(bomb)[0] == "x"
    lies = bytearray(word(p("y" * 5000)))
    at = lies.rindex(b"PK\x01\x02")
    lies[at + 24 : at + 28] = (10).to_bytes(4, "little")  # the directory says ten bytes
    assert office.word_text(bytes(lies), most=1000)[1] in (office.TOO_LARGE, office.BROKEN)


def test_files_to_a_profile(spark, tmp_path):
    cvs = {"a.docx": word(p("Jane") + table((p("Key Skills:"),), (p("Docker, Excel"),))), "b.pdf": b"%PDF-1.7", "c.docx": b"hello", "d.pdf": word(p("renamed"))}
    for name, data in cvs.items():
        (tmp_path / name).write_bytes(data)
    read = office.cv_files(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), office.cv_text(F.col("content")).alias("cv"))
    assert {r.name: tuple(r.cv) for r in read.collect()} == {"a.docx": ("Jane\nKey Skills:\nDocker, Excel", None), "b.pdf": (None, None), "c.docx": (None, office.NO_FORMAT), "d.pdf": ("renamed", None)}
    assert read.where("name = 'a.docx'").select(profiles.declared_skills(F.col("cv.text")).alias("s")).first().s == ["Docker", "Excel"]


@pytest.mark.parametrize("most", [10**6, 40])
def test_workbooks_come_back(spark, tmp_path, most):
    rows = [(k, f"title {k} <&> \"é\"" if k % 3 else None, " two\nlines \x01") for k in range(100)]
    df = spark.createDataFrame(rows, "id long, `A title` string, note string").repartition(3)
    office.export_xlsx(df, str(tmp_path / "x"), "id", most=most)
    got = office.read_xlsx(spark, str(tmp_path / "x")).collect()
    names = sorted({r.file for r in got})
    assert (len(names) == 1) == (most == 10**6) and all(r.frozen and r.sheet == "Jobs" for r in got)
    assert all(r.cells == ["id", "A title", "note"] and r.bold for r in got if r.at == 1) and not any(r.bold for r in got if r.at > 1)
    body = [r.cells for r in sorted(got, key=lambda r: (r.file, r.at)) if r.at > 1]
    assert body == [[str(k), t or "", " two\nlines "] for k, t, _ in rows]
    assert not [f for f in (tmp_path / "x").iterdir() if f.name.startswith("_")]
    office.export_xlsx(df.where("false"), f"file://{tmp_path}/none", "id")
    assert [r.cells for r in office.read_xlsx(spark, f"file://{tmp_path}/none").collect()] == [["id", "A title", "note"]]


def test_export_labels(spark, tmp_path):
    assert len(files.EXPORT) == 23
