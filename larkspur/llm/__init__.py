"""Training-data operators: ten corpus operators that the rest of the library does not depend on."""
