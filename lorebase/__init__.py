"""lorebase: document-intelligence analytics as Spark plans.

The sub-packages are

* ``functions``  column expressions (text, numbers, JSON, query language)
* ``operators``  DataFrame -> DataFrame operators
* ``sources``    readers and writers (tables, bundles, Markdown, config)
* ``plans``      stage plans and the query catalogue
* ``streaming``  incremental runs on Structured Streaming
* ``llm``        operators for training data; nothing else imports it
"""

__version__ = "0.1.0"
