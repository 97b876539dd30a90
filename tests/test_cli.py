"""The command line: exit codes, parameters, output files, formatting."""

from sylvan.__main__ import main

SHEET = '<x:stylesheet version="1.0" xmlns:x="http://www.w3.org/1999/XSL/Transform"><x:param name="p" select="0"/><x:template match="/"><r><p><x:value-of select="$p"/></p><x:apply-templates/></r></x:template></x:stylesheet>'


def test_main(spark, tmp_path, capsys):
    (tmp_path / "s.xsl").write_text(SHEET)
    (tmp_path / "a.xml").write_text("<a>A</a>")
    (tmp_path / "b.xml").write_text("<a>")
    out = tmp_path / "out"
    assert main([str(tmp_path / "s.xsl"), str(tmp_path / "a.xml"), "-o", str(out), "-p", "p=7", "-f"]) == 0
    assert out.read_text() == "<r>\n  <p>7</p>A</r>\n"
    assert main([str(tmp_path / "s.xsl"), str(tmp_path / "b.xml")]) == 1 and "no element found" in capsys.readouterr().err
    assert main([str(tmp_path / "none.xsl"), str(tmp_path / "a.xml")]) == 1
