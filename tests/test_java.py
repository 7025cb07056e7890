"""Java token table."""

from codeweigh.operators.tokens import java_token_table

SRC = ('public non-sealed class A { /* c */ int x = 0x1F + 07 + 1_000L + 1.5e3f; // t\n'
       '  String s = "a\\"b"; char c = \'\\n\'; x >>= 2; y = a >> b; boolean t = true; Object o = null; }\n'
       '  String tb = """\n   hi\n   """; #')


def test_java_tokens(spark):
    df = spark.createDataFrame([(1, SRC)], "id long, src string")
    rows = java_token_table(df, "id", "src").orderBy("pos").collect()
    assert "".join(r.text for r in rows) == SRC
    vis = [(r.name, r.text) for r in rows if not r.hidden]
    names = [n for n, _ in vis]
    assert ("NON_SEALED", "non-sealed") in vis
    assert ("HEX_LITERAL", "0x1F") in vis and ("OCT_LITERAL", "07") in vis
    assert ("DECIMAL_LITERAL", "1_000L") in vis and ("FLOAT_LITERAL", "1.5e3f") in vis
    assert ("STRING_LITERAL", '"a\\"b"') in vis and ("CHAR_LITERAL", "'\\n'") in vis
    assert ("RSHIFT_ASSIGN", ">>=") in vis
    i = names.index("IDENTIFIER", names.index("RSHIFT_ASSIGN") + 4)
    assert names[i + 1: i + 3] == ["GT", "GT"]
    assert ("BOOL_LITERAL", "true") in vis and ("NULL_LITERAL", "null") in vis
    assert any(n == "TEXT_BLOCK" for n in names)
    hidden = {r.name for r in rows if r.hidden}
    assert {"WS", "COMMENT", "LINE_COMMENT", "UNMATCHED"} <= hidden
