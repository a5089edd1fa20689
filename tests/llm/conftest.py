import os
import sys

sys.path.append(os.path.dirname(os.path.abspath(__file__)))  # last: test_search without a package is the one beside this folder
