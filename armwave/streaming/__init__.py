"""The stateless part of the library on streams."""
