"""Named queries of the library and the SQL that checks them."""
