"""shelfmark: file-catalog analytics as PySpark DataFrame functions.

Every operator is ``f(df, ..., *, as_of=None) -> DataFrame``.  Nothing in the
package collects rows to the driver; rules, templates and thresholds are small
driver-side configuration that compiles to Spark expressions.
"""

__version__ = "0.1.0"
