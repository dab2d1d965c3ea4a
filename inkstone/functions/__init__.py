"""Column functions over text: no shuffle, no Python on the executors."""
