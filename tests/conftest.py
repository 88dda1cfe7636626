import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


#: Stand-ins for the PDF tools: a "PDF" holds a text, and after a line of its own the layout.
TOOL = """#!{python}
import sys
name, arguments = {name!r}, sys.argv[1:]
data = open(arguments[-2], encoding="utf-8").read()
if "BROKEN" in data or (name == "pdftohtml" and "NOLAYOUT" in data):
    sys.exit("damaged file")
text, _, layout = data.partition("%LAYOUT\\n")
if name == "pdftotext":
    sys.stdout.write(text)
else:
    import os, shutil
    open(arguments[-1], "w", encoding="utf-8").write(layout.replace("$DIR", os.path.dirname(arguments[-1])))
    if os.path.exists({image!r}):
        shutil.copy({image!r}, os.path.join(os.path.dirname(arguments[-1]), "shot.png"))
"""


def png(width, height, filler=0):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = (b"\0" + bytes([filler]) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tools = tmp_path_factory.mktemp("tools")
    (tools / "shot.png").write_bytes(png(100, 80))
    for name in ("pdftotext", "pdftohtml"):
        (tools / name).write_text(TOOL.format(python=sys.executable, name=name, image=str(tools / "shot.png")))
        (tools / name).chmod(0o755)
    os.environ["PATH"] = os.pathsep.join([str(tools), os.environ["PATH"]])
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
