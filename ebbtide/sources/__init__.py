from ebbtide.sources.tables import SCHEMAS, SchemaDrift, check_schema, literal_rows, load, write_result

__all__ = ["SCHEMAS", "SchemaDrift", "check_schema", "literal_rows", "load", "write_result"]
