"""Search parameters and the catalogue of registered queries."""
