"""The thin queries over the operators of this subpackage."""
