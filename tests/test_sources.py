import base64
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.errors import Conflict, FileError, NotFound
from tessera.functions import models, text
from tessera.operators import chat
from tessera.sources import notes_xml, readers

GIF = b"GIF89a" + bytes(range(80))
B64 = base64.b64encode(GIF).decode()
NOTE = f"""<database replicaid="R" title="T"><document><noteinfo><unid>U</unid></noteinfo>
<wrap><item name="Title"><text>Old</text></item><item name="ＳＵＢＪＥＣＴ"><text>S</text></item></wrap><item name="OtherDepNm"><text> Dep </text></item><item name="Form"><text>F</text></item>
<item name="Cate1"><text>one</text></item><item name="cate2"><text>一</text></item><item name="cate3"><text>three</text></item>
<item name="Body"><richtext><par>a <urllink href="http://x/(1)">l[1]</urllink></par><table><row><cell rowspan="2">A</cell><cell colspan="2">B|c</cell></row><row><cell>D</cell><cell>E<table><row><cell>in</cell></row></table></cell></row><tablerow><tablecell columnspan="x">G</tablecell></tablerow></table></richtext></item>
<item name="body_1"><par>b<doclink database="R2" document="U2"/></par><par><gif>{B64}</gif></par></item>
<item name="tmp"><richtext><par><caption> c </caption></par></richtext></item>
<item name="$FILE"><object><file name="x:y.gif" size="86" hosttype="bytearray" flags="storedindoc" compression="none"><created><datetime>20240101T000000</datetime></created><filedata>{B64}</filedata></file><file name="empty"/></object></item>
</document><note><noteinfo noteid="9"/></note></database>"""


def test_note():
    a, b = notes_xml.parse(NOTE, "notes://s/", "http://h/")
    m = a["metadata"]
    assert (a["doc_id"], m["subject"], m["owner_department"], m["form"], m["categories"], m["notes_link"], m["http_link"]) == ("R:U", "S", "Dep", "F", ["one", "three"], "notes://s/R/0/U", "http://h/R/0/U")
    body = a["body_text"].split("\n\n")
    assert body[0] == "a [l\\[1\\]](http://x/%281%29)"
    assert body[1].split("\n") == ["| A | B\\|c | B\\|c |", "| --- | --- | --- |", "| A | D | Ein |", "| G |  |  |"]
    assert body[2:4] == ["b[添付資料](notes://s/R2/0/U2)", "![](images/R_U/img_0001.gif)"]
    assert body[4:] == ["### 添付資料", "- c", "#### ファイル", "- [x:y.gif](attachments/R_U/att_0001_x_y.gif)"]
    assert (a["images"][0]["mime"], a["images"][0]["source_tag"], len(a["attachments"])) == ("image/gif", "gif", 1)
    assert (a["attachments"][0]["created"], a["attachments"][0]["declared_size"], a["attachments"][0]["modified"]) == ("20240101T000000", 86, None)
    assert b["doc_id"] == "9" and b["body_text"] == ""
    assert notes_xml.kind_of(b"\xff\xd8\x00") == "jpg" and notes_xml.MIME["tif"] == "image/tiff"


def test_notes_to_ndjson(spark, tmp_path):
    """What one writes the other reads; a damaged file is reported and harms no other."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.xml").write_text(NOTE)
    (tmp_path / "in" / "bad.xml").write_text("<database>")
    got = notes_xml.read(spark, str(tmp_path / "in"), data=True)
    assert [r["file_path"].endswith("bad.xml") for r in got.where("error is not null").collect()] == [True]
    assert bytes(got.where("doc_id = 'R:U'").first()["images"][0]["data"]) == GIF
    readers.write_ndjson(notes_xml.documents(notes_xml.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"))
    rows = {r["source_doc_id"]: r for r in readers.read_ndjson(spark, str(tmp_path / "out")).collect()}
    assert rows["R:U"]["category_2"] == "three" and rows["R:U"]["category_3"] == "" and rows["9"]["category_1"] == "" and rows["R:U"]["owner_department"] == "Dep"
    line = next(json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines() if "R:U" in x)
    assert set(line["images"][0]) == {"image_id", "rel_path", "content_hash", "mime", "source_tag", "size_bytes"} and len(line["attachments"][0]) == 11


def _zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)


def test_files(spark, tmp_path):
    """Dispatch by suffix in any case, charsets, numbering, and a broken file and slide that harm nothing else."""
    d = tmp_path / "files"
    d.mkdir()
    (d / "a.TXT").write_bytes("日本語".encode("cp932"))
    (d / "b.txt").write_bytes(b"\xef\xbb\xbfHello world")
    (d / "c.html").write_text("<html><body><h1>Title</h1><p>Some paragraph.</p></body></html>")
    w = 'xmlns:w="w"'
    _zip(d / "d.docx", {"word/document.xml": f"<w:document {w}><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Th</w:t><w:t>ree</w:t></w:p></w:document>"})
    slide = '<s xmlns:a="a"><a:txBody><a:p><a:t>{}</a:t></a:p></a:txBody></s>'
    _zip(d / "e.pptx", {"ppt/slides/slide1.xml": slide.format("S1"), "ppt/slides/slide2.xml": slide.format(" "), "ppt/slides/slide10.xml": slide.format("S10"), "ppt/slides/slide3.xml": "<broken"})
    (d / "f.docx").write_bytes(b"no zip")
    got = sorted((r["source_id"], r["unit_index"], r["page_number"], r["text"]) for r in readers.read_files(spark, str(d), 10).collect())
    assert got == [("a", 0, 10, "日本語"), ("b", 0, 10, "Hello world"), ("c", 0, 10, "Title Some paragraph."), ("d", 0, 10, "One"), ("d", 2, 12, "Three"), ("e", 0, 10, "S1"), ("e", 3, 13, "S10")]
    assert [r["file_path"].rsplit("/", 1)[1] for r in readers.file_errors(spark, str(d)).collect()] == ["f.docx"]
    (d / "g.xyz").write_text("x")
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_files(spark, str(d))
    more = readers.READERS | {"xyz": lambda raw: [(0, "mine")]}
    assert readers.read_files(spark, str(d / "g.xyz"), readers=more).first()["text"] == "mine"
    with pytest.raises(FileError):
        readers.units("docx", b"x")
    assert readers.read_text(spark, str(d / "b.txt")).count() == 1


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"SEARCH": {"TOP_K": "7", "N": 3}, "X": {"EMPTY": ""}}')
    c = EngineConfig.load(str(tmp_path / "c.json"))
    assert (c.get("SEARCH", "TOP_K"), c.get("SEARCH", "N"), c.get("BM25", "K1"), c.get("X", "EMPTY", "d"), c.get("Q", "Q", "d")) == ("7", None, "1.5", "", "d")
    monkeypatch.setenv("SEARCH.TOP_K", "")
    assert c.get("SEARCH", "TOP_K") == ""
    monkeypatch.setenv("SEARCH.TOP_K", "9")
    assert c.get("SEARCH", "TOP_K") == "9"
    c.set("X", "Y", 1)
    c.save(str(tmp_path / "d.json"))
    assert EngineConfig.load(str(tmp_path / "d.json")).get("X", "Y") == "1"
    with pytest.raises(ValueError):
        c.save(str(tmp_path / "d.txt"))


def test_sessions(spark):
    schema = "user_id string, session_id string, session_name string, last_touched_at int, is_deleted boolean"
    rows = [("u", f"s{k}", "Untitled Session", k, False) for k in range(10)]
    sessions, new = spark.createDataFrame(rows, schema), spark.createDataFrame([("u", "n", "Untitled Session", 99, False)], schema)
    known = [f"s{k}" for k in range(10)]
    live = lambda df: sorted(r["session_id"] for r in df.where("not is_deleted").collect())
    assert live(chat.create_session(sessions, new, known, "s0")) == ["n", *known[1:]]
    for ids, victim in ((known[1:], "s0"), (known, "s1"), (known, None)):
        with pytest.raises(Conflict):
            chat.create_session(sessions, new, ids, victim)
    key = {"user_id": "u", "session_id": "s3"}
    assert chat.update_session(sessions, key, {"session_name": "Untitled Session"}, {"session_name": "x"}).where("session_name = 'x'").count() == 1
    with pytest.raises(Conflict):
        chat.update_session(sessions, key, {"session_name": "other"}, {"session_name": "x"})
    with pytest.raises(NotFound):
        chat.update_session(sessions, {"user_id": "v"}, {}, {"session_name": "x"})
    titled = chat.set_title(sessions, spark.createDataFrame([("s1", " t "), ("s2", " ")], "session_id string, title string"))
    assert titled.where("session_name = 't'").count() == 1 and titled.count() == 10
    with pytest.raises(ValueError):
        chat.set_title(sessions, spark.createDataFrame([("s1", "a"), ("s1", "b")], "session_id string, title string"))


def test_rounds(spark):
    schema = "conv_id long, turn long, role string, text string, round_id long, is_deleted boolean"
    claimed = chat.claim_round(spark.createDataFrame([], schema), spark.createDataFrame([(1, 0, "user", "q", 0, True)], schema))
    with pytest.raises(Conflict):
        chat.claim_round(claimed, spark.createDataFrame([(1, 5, "user", "again", 0, True)], schema))
    done = chat.finalize_round(claimed, spark.createDataFrame([(1, 1, "system", "ctx", 0, False), (1, 2, "assistant", "a", 0, False)], schema))
    assert done.where("is_deleted").count() == 0
    assert [r["role"] for r in chat.in_order(done).orderBy("place").collect()] == ["user", "assistant", "system"]
    assert chat.count_rounds(done).first()["n_rounds"] == 1
    patch = spark.createDataFrame([(1, "good")], "conv_id long, feedback string")
    assert chat.patch_feedback(done, patch).where("feedback = 'good'").count() == 1
    with pytest.raises(ValueError):
        chat.patch_feedback(done, patch.union(patch))
    with pytest.raises(NotFound):
        chat.patch_feedback(done, spark.createDataFrame([(2, "bad")], "conv_id long, feedback string"), strict=True)
    said = chat.prompt(done, "be kind").first()["prompt"]
    assert said[0]["text"] == "be kind" and len(said) == 4
    with pytest.raises(NotFound):
        chat.soft_delete(done, spark.createDataFrame([(9, 0)], "conv_id long, round_id long"), strict=True)


def test_scalars_and_models(spark):
    one = spark.createDataFrame([("ＡＢ c ", "a|b\r\nc", GIF, B64, "AB cd")], "n string, cell string, img binary, b64 string, t string")
    got = one.select(text.item_name(F.col("n")), text.table_cell(F.col("cell")), text.image_kind(F.col("img")), text.decode_base64(F.col("b64")), text.unescape(F.lit("&eacute;")),
                     text.morphological(F.col("t"), lambda t: [("名詞", w) for w in t.split()] + [("助詞", "x")], stop=("cd",))).first()
    assert got[:3] == ("ab c", "a\\|b<br>c", "gif") and bytes(got[3]) == GIF and got[4:] == ("é", ["ab"])
    adapter = models.EmbeddingAdapter(models.HashingEmbedder(8))
    assert len(adapter("a b")) == 8 and len(adapter(["a", "b"])) == 2
    with pytest.raises(ValueError):
        adapter([1])
    with pytest.raises(RuntimeError):
        models.require_module("no_such_module_here", "a model")
    assert text.load_plugin("tessera.functions.models:HashingEmbedder") is models.HashingEmbedder
    assert one.select(models.masked_mean(F.array(F.array(F.lit(1.0)), F.array(F.lit(5.0))), F.array(F.lit(0), F.lit(0)))).first()[0] is None
    close = one.select(models.text_cosine(F.lit("a b"), F.lit("a b"), models.HashingEmbedder(8)), models.text_cosine(F.lit(""), F.lit("a"), models.HashingEmbedder(8))).first()
    assert abs(close[0] - 1) < 1e-6 and close[1] is None
