"""See the package README for the contents of this subpackage."""
