"""Column expressions (JVM-side, codegen-friendly). No Python UDFs live here."""

from murmur.functions.text import (  # noqa: F401
    chunk_array, link_id_from_permalink, normalise_link_id, relevance, stringify, topic,
)
from murmur.functions.labels import five_class, three_class  # noqa: F401
from murmur.functions.numeric import engagement, safe_ratio  # noqa: F401
