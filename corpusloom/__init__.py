"""corpusloom: a Spark-first analytics engine over structured document corpora.

``sources`` lists and parses a corpus, ``functions`` holds pure text functions,
``operators`` holds the relational and graph operators, and ``plans`` holds
session helpers and composite queries.
"""

__version__ = "0.1.0"
