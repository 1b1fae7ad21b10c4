"""lodestone: a Spark-first engine for self-describing records.

``functions`` holds Column builders, ``operators`` DataFrame operators, ``sources``
readers and writers, ``streaming`` the Structured Streaming operators and ``plans``
the query catalogue. The optional subpackage ``llm`` holds training-data operators;
nothing else imports it.
"""

__version__ = "0.1.0"
