"""Page images, recognition and image measures as adapters: what draws and reads pages is given, since neither is part of this library.

Drawers and engines are made once per task, by a function without arguments, and used for all its pages. Images are 8-bit BGRA rows of
`stride` bytes. A page that can't be drawn or read gives one row with `error` and nothing else, so that others go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

IMAGE = "doc_id long, page int, image binary, width int, height int, stride int, error string"
LINES = "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, error string"
MEASURES = "doc_id long, page int, skew double, x0 int, y0 int, x1 int, y1 int, error string"
STEP, HIGH, DARK = 14, 12, 180
#: Angles tried for the skew, in degrees.
ANGLES = [x / 4 for x in range(-20, 21)]


def _each(rows: DataFrame, columns: list[str], schema: str, start: Callable, work: Callable) -> DataFrame:
    """work(tool, row) gives the rows of each row, tool = start() once per task; an exception gives a row with the key and error."""
    fields = [x.split() for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        of = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        tool = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in columns}
                try:
                    tool = start() if tool is None else tool
                    out = list(work(tool, row))
                except Exception as e:  # noqa: BLE001
                    out = [{"doc_id": row["doc_id"], "page": row["page"], "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], of[t]) for n, t in fields], [n for n, _ in fields])

    return rows.select(*columns).mapInArrow(run, schema)


def drawn(requests: DataFrame, drawer: Callable, dpi: int = 300) -> DataFrame:
    """IMAGE of requests (doc_id, page, content): drawer()(content, page, dpi) gives (image, width, height, stride)."""

    def work(draw, row):
        image, width, height, stride = draw(row["content"], row["page"], dpi)
        yield {"doc_id": row["doc_id"], "page": row["page"], "image": image, "width": width, "height": height, "stride": stride}

    return _each(requests, ["doc_id", "page", "content"], IMAGE, drawer, work)


def pixels(row: dict):
    """Rows x columns x BGRA of an image."""
    import numpy as np

    if not row["image"] or row["width"] <= 0 or row["height"] <= 0:
        raise ValueError("no image")
    rows = np.frombuffer(row["image"], np.uint8)[: row["height"] * row["stride"]].reshape(row["height"], row["stride"])
    return rows[:, : row["width"] * 4].reshape(row["height"], row["width"], 4)


def recognised(images: DataFrame, engine: Callable, dpi: int = 300) -> DataFrame:
    """LINES of IMAGE: engine()(RGBA array, dpi) gives a text, whose lines are trimmed and set STEP apart; blank ones go."""

    def work(read, row):
        texts = (x.strip() for x in read(pixels(row)[:, :, [2, 1, 0, 3]], dpi).split("\n"))
        for i, text in enumerate(x for x in texts if x):
            yield {"doc_id": row["doc_id"], "page": row["page"], "line_no": i, "text": text, "x0": 0.0, "y0": float(i * STEP), "x1": float(row["width"]), "y1": float(i * STEP + HIGH)}

    return _each(images.filter("error IS NULL"), ["doc_id", "page", "image", "width", "height", "stride"], LINES, engine, work)


def tesseract(language: str = "eng") -> Callable:
    """An engine by the package pytesseract, which is looked for when a task first needs it."""

    def start():
        import pytesseract
        from PIL import Image

        return lambda rgba, dpi: pytesseract.image_to_string(Image.fromarray(rgba), lang=language, config=f"--dpi {dpi}")

    return start


def measured(images: DataFrame) -> DataFrame:
    """MEASURES of IMAGE: the box around what is darker than DARK, null if nothing is, and the angle by which the page is turned: that along
    which its dark rows are told apart best."""

    def work(np, row):
        dark = pixels(row)[:, :, :3].mean(axis=2) < DARK
        ys, xs = np.nonzero(dark)
        out = {"doc_id": row["doc_id"], "page": row["page"], "skew": 0.0}
        if len(ys):
            out |= {"x0": int(xs.min()), "y0": int(ys.min()), "x1": int(xs.max()) + 1, "y1": int(ys.max()) + 1}
            turned = {a: np.bincount((lambda z: z - z.min())(np.rint(ys - xs * np.tan(np.radians(a))).astype(np.int64))).astype(np.float64) for a in ANGLES}
            out["skew"] = max(ANGLES, key=lambda a: ((turned[a] ** 2).sum(), -abs(a)))
        yield out

    def start():
        import numpy

        return numpy

    return _each(images.filter("error IS NULL"), ["doc_id", "page", "image", "width", "height", "stride"], MEASURES, start, work)
