"""Small projects whose facts and graph were derived by hand."""

PYTHON = {
    "calculator.py": "class Calculator:\n    def __init__(self):\n        self.value = 0\n\n    def add(self, a, b):\n        return a + b\n\n    def subtract(self, a, b):\n        return a - b\n\n    def reset(self):\n        self.value = 0\n",
    "calls.py": "def helper(x):\n    return x * 2\n\ndef main():\n    return helper(3)\n",
    "inheritance.py": "class Animal:\n    def speak(self):\n        return 'sound'\n\nclass Dog(Animal):\n    def speak(self):\n        return 'woof'\n\nclass Cat(Animal):\n    def speak(self):\n        return 'meow'\n",
    "instance_usage.py": "from calculator import Calculator\n\ndef use_via_instance():\n    calc = Calculator()\n    return calc.add(1, 2)\n",
    "mixed.py": "import os\nfrom pathlib import Path\n\ndef load_config(path):\n    with open(path) as f:\n        return f.read()\n\ndef save_result(path, data):\n    Path(path).write_text(data)\n\nclass DataProcessor:\n    def process(self, raw):\n        return raw.strip().lower()\n\n    def validate(self, data):\n        return len(data) > 0\n",
    "simple.py": "def test_function(x):\n    if x > 0:\n        return True\n    else:\n        return False\n\ndef loop_example(items):\n    result = []\n    for item in items:\n        if item > 5:\n            result.append(item)\n    return result\n",
}
CALLS = {
    ("function:calls.py:main", "function:calls.py:helper", 5),
    ("function:instance_usage.py:use_via_instance", "class:calculator.py:Calculator", 4),
    ("function:instance_usage.py:use_via_instance", "function:instance_usage.py:calc.add", 5),
    ("function:mixed.py:load_config", "function:mixed.py:open", 5),
    ("function:mixed.py:load_config", "function:mixed.py:f.read", 6),
    ("function:mixed.py:save_result", "function:mixed.py:write_text", 9),
    ("function:mixed.py:save_result", "function:mixed.py:Path", 9),
    ("function:mixed.py:DataProcessor.process", "function:mixed.py:lower", 13),
    ("function:mixed.py:DataProcessor.process", "function:mixed.py:raw.strip", 13),
    ("function:mixed.py:DataProcessor.validate", "function:mixed.py:len", 16),
    ("function:simple.py:loop_example", "function:simple.py:result.append", 11),
}
