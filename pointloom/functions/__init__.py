"""Column functions: scalar maths, rotations, spherical harmonics, text. All stay inside the JVM."""
