"""The registered queries: the library's operators on the driver's tables, with SQL to check them."""
