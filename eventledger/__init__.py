"""Analytics over transactional message ledgers, on PySpark."""
