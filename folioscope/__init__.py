"""folioscope: evaluation and clean-up of recognised page text on PySpark.

Subpackages: ``sources`` read layout XML, METS and plain text; ``functions`` hold column
expressions; ``operators`` hold relational operators; ``plans`` compile specifications into one
DataFrame; ``streaming`` runs the mergeable statistics over a stream. The subpackage ``llm`` is
optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
