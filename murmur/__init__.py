"""murmur — social-sentiment x market-liquidity analytics as Spark DataFrame operators.

Every public operator is a pure, lazy ``DataFrame -> DataFrame`` function. Nothing is
collected to the driver except bounded results (<= a few hundred rows) that an operator
documents as such.
"""

__version__ = "0.1.0"
