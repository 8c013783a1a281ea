"""millstone: Spark-native preparation of multi-source text corpora.

Raw text tables -> cleaned, scored, per-source quality-cut documents ->
weighted, seeded mixture -> byte-level BPE -> fixed-length token sequences
-> training batch layout. Every step is a ``DataFrame -> DataFrame`` or
``Column -> Column`` function.
"""

__version__ = "0.1.0"
