"""Every operator bound to the test tables, with the same question in SQL where SQL can ask it."""
