"""Model files: the data source against whole texts, pieces of any size, memory, hidden and odd names."""

import random
import tracemalloc

from tessera.sources import xml_files, xml_model
from test_metadata import LEGACY, MODEL


def test_pieces_of_any_size_give_the_same_rows():
    for text in (MODEL, LEGACY, MODEL[: len(MODEL) // 2], LEGACY.replace("SHELF", "é ñ 木"), "", "no xml", "<a>x<b> y </b> z</a>"):
        whole, data = list(xml_files.parse([text.encode()])), text.encode()
        for size in (1, 7, 64):
            assert list(xml_files.parse(data[i : i + size] for i in range(0, len(data), size))) == whole
        assert sorted(r[0] for r in whole) == list(range(len(whole)))


def test_rows_of_nodes():
    rows = {r[0]: r for r in xml_files.parse([b'<r><o:Table Id="t1"> <a:Name>x</a:Name><a:Name>y</a:Name><c/></o:Table> tail <d>1<e>2</e></d></r>'])}
    # node, parent, tag, scalar, label, is_first, ancestors, within
    assert rows[0] == (0, -1, "r", "tail", "x", True, [], {})
    assert rows[1] == (1, 0, "table", None, "x", True, [0], {})
    assert rows[2] == (2, 1, "id", "t1", "t1", True, [0, 1], {"table": 1})
    assert [rows[i][3:6] for i in (3, 4, 5)] == [("x", "x", True), ("y", "y", False), ("", "", True)]
    assert rows[6][3:5] == ("1", "2") and rows[7] == (7, 6, "e", "2", "2", True, [0, 6], {})


def test_a_long_file_needs_no_more_memory():
    def pieces(n):
        yield b"<m>"
        for i in range(n):
            yield b'<o:Table Id="t%d">\n<a:Name>n</a:Name>\n</o:Table>\n' % i * 20
        yield b"</m>"

    peaks = []
    for n in (200, 4000):
        tracemalloc.start()
        assert sum(1 for _ in xml_files.parse(pieces(n))) == 1 + 60 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + 100_000


def test_the_source_equals_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "sub").mkdir()
    (tmp_path / "_hidden").mkdir()
    for name, text in {"a.v1.xml": MODEL, "sub/é 100%.pdm": LEGACY, "sub/cut.xml": MODEL[: rng.randrange(len(MODEL))], "bare": "<o:Model/>", "empty.xml": "", "_hidden/c.xml": MODEL, ".d.xml": MODEL}.items():
        (tmp_path / name).write_text(text)
    path = f"file://{tmp_path}"
    texts = {"a.v1": MODEL, "é 100%": LEGACY, "cut": (tmp_path / "sub/cut.xml").read_text(), "bare": "<o:Model/>"}
    for task in ("1", "1000000"):
        read = xml_files.read_nodes(spark, path, taskBytes=task)
        assert read.rdd.getNumPartitions() == (4 if task == "1" else 1)
        got = read.collect()
        names = {r.model_id: r.model_name for r in got if r.node == -1}
        assert sorted(names.values()) == sorted(texts)
        for ident, name in names.items():
            assert [tuple(r)[2:] for r in got if r.model_id == ident and r.node >= 0] == list(xml_files.parse([texts[name].encode()]))
    assert {r.model_name for r in xml_files.read_nodes(spark, path, pathGlobFilter="*.pdm").filter("node = -1").collect()} == {"é 100%"}
    whole = xml_model.read_files(spark, f"{path}/sub")
    assert {r.model_id for r in whole.collect()} == {i for i in names if "/sub/" in i}
