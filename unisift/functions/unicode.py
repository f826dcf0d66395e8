"""Normal forms, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t


def forms(text: str) -> dict[str, str]:
    """NFC, NFKC, and the skeleton: NFD, then each look-alike replaced by its letter, then NFD."""
    skeleton = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(t.CONFUSABLES))
    return {"nfc": unicodedata.normalize("NFC", text), "nfkc": unicodedata.normalize("NFKC", text), "skeleton": skeleton}


_FORMS = pa.struct([("nfc", pa.string()), ("nfkc", pa.string()), ("skeleton", pa.string())])


def _normal_forms(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else forms(x) for x in texts.to_pylist()], _FORMS)


def normal_forms(text: Column) -> Column:
    """`forms` as an Arrow function; call it on texts beyond ASCII only, others are their own forms."""
    return F.arrow_udf(_normal_forms, "struct<nfc: string, nfkc: string, skeleton: string>")(text)
