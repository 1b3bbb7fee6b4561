"""Production parameters that queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sources are parted into domains by the first digit of their name's md5, as a stand-in for a catalogue of sources.
DOMAINS = {"web": "0123456", "books": "789ab", "code": "cdef"}
WEIGHTS = {("web",): 2.0, ("books",): 1.0, ("code",): 1.0, ("web", "en"): 3.0, ("books", "en"): 2.0, ("web", "en", "src0"): 4.0}
#: A line on so many sources is boilerplate.
BOILERPLATE_SITES = 3
#: Texts that score less are rejected.
QUALITY = 0.3


def levels() -> dict[str, Column]:
    first = F.substring(F.md5(F.coalesce(F.col("source").cast("string"), F.lit(""))), 1, 1)
    web, books, code = DOMAINS
    domain = F.when(first.isin(*DOMAINS[web]), web).when(first.isin(*DOMAINS[books]), books).otherwise(code)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
