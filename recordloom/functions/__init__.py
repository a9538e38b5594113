"""Column functions and Arrow UDFs: normalisation, phonetics, string distances, text vectors."""
