"""Nothing here yet: the operators of this library are batch operators by nature."""
