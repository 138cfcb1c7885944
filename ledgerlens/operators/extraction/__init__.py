"""Text to structured invoices.

A document is one row and stays one row: its lines are an array, and every step is an expression over that
array.  Nothing is shuffled from the corpus scan to the finished invoice, and the work of a task is bounded
by the texts it reads.  Operators that return several rows per document explode at the end.
"""
