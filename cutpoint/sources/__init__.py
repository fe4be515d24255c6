"""Fact tables: schemas, readers and bindings of other tables to them."""
